import re
from collections import Counter

from loomgraph.llm import quality

CLEAN = "the house of the man and to the river in a town that is it for on was be as with by this are old trees near water under bright evening sky "


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def varied(n):
    """Clean prose in which no five words repeat."""
    words = CLEAN.split()
    return " ".join(words[(k * k + k // 7) % len(words)] for k in range(n))


def test_counts_and_verdicts(spark):
    texts = {
        1: None, 2: "", 3: " \n\t", 4: "a b c d e a b c d e x", 5: "x x x x x x x x x x x", 6: "é ß 日本 #* $|\n\nl l\nl l\n l l\n",
        7: varied(300), 8: " ".join(f"w{k}%%% q{k}&&&" for k in range(200)), 9: " ".join("zq" + "abcdefghij"[k % 10] * (k % 7 + 1) + chr(97 + k // 10) for k in range(240)), 10: varied(9), 11: "a" * 100000,
        12: "p q r s t u v w x y p q r s t", 13: "one\rtwo\x0bthree\x0cfour five six seven eight nine ten eleven",
    }
    docs = spark.createDataFrame([(k, t, "en", "clash") for k, t in texts.items()] + [(100 + k, varied(200 + k), "en", "") for k in range(30)], "doc_id long, text string, lang string, kept string")
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    for k, t in texts.items():
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(t), k
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    assert got[8]["kept"] is False and not got[8]["base_failed"] and got[9]["kept"] is False and not got[9]["base_failed"]
    clean = [r for k, r in got.items() if k >= 100 or k == 7]
    assert all(r["kept"] == (not r["base_failed"]) for r in clean)
    assert quality.judged(docs.limit(0)).count() == 0


def test_without_references(spark):
    docs = spark.createDataFrame([(1, varied(100), None), (1, varied(100), "xx")], "doc_id long, text string, lang string")
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.judged(docs).collect())
