"""Quality rules by distribution divergence, with DataFrame functions only.

Each text has two histograms: character classes, and the common words of each reference language against all its other words.
A language's reference is the sum of the histograms of all documents whose `lang` names it and that pass the base rules. A text
is rejected if it is further than MOST_CHARS (classes) or MOST_WORDS + 1 / sqrt(its words) (common words; the second term
allows for the noise of a small sample) in Jensen-Shannon distance (base 2, 0 to 1) from every reference. Texts under
LEAST_CHARS characters or LEAST_WORDS words are too short to tell and are not rejected by the respective histogram.

Results for odd inputs: a null or empty text has no words and fails the base rules; without any reference (no document of a
known language passes) nothing diverges; repeated rows keep a row each; an empty table gives no rows. Repeats of word windows
are found by 64-bit hashes of five words. Only the id, text and lang columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

# Frequent function words of each language.
COMMON = {
    "de": "der die und den von zu das mit sich des auf für ist im dem ein eine nicht".split(),
    "en": "the of and to in a is that it for on was be as with by this are".split(),
    "es": "de la que el en y a los del se las por un para con no una su".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
# Character classes, as regular expressions; all other characters are the last class.
BLANK = "[ \\t\\n\\x0B\\f\\r]"
CLASSES = ["[a-z]", "[A-Z]", "[^\\x00-\\x7F]", "[0-9]", BLANK, "[.,;:!?'\"()-]"]
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
LEAST_CHARS, LEAST_WORDS = 200, 80
MOST_CHARS, MOST_WORDS = 0.29, 0.18


def windows_repeated(words: Column, n: int = 5) -> Column:
    """How many words lie in n-word windows that are found twice or more in the list."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            # equal[k]: the k-th hash equals the next one
            equal = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: a["h"] == b["h"])

            def of_equal(e: Column) -> Column:
                twice = F.filter(F.transform(s, lambda x, k: F.when(F.coalesce(F.get(e, k), F.lit(False)) | F.coalesce(F.get(e, k - 1), F.lit(False)), x["i"])), lambda i: i.isNotNull())
                return let(F.array_sort(twice), lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(n), b - a)), F.lit(0).cast("long"), lambda acc, x: acc + x))

            return let(equal, of_equal)

        crowded = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(crowded)

    def of_words(hs: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(hs) - n), lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(n)]))
        return F.when(F.size(hs) < n + 1, F.lit(0).cast("long")).otherwise(let(grams, of_hashes))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def common_counts(text: Column) -> Column:
    """The count of each of WORDS among the letter runs of the lower-cased text, then the count of all runs."""
    runs = F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: w != "")

    def of_found(s: Column) -> Column:
        def of_kinds(kinds: Column) -> Column:
            firsts = F.transform(kinds, lambda w: F.array_position(s, w))
            counts = F.zip_with(firsts, F.slice(F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(F.size(s).cast("long") + 1)), 1, F.size(firsts)), lambda a, b: (b - a).cast("int"))
            return let(F.map_from_arrays(kinds, counts), lambda m: F.transform(F.array(*map(F.lit, WORDS)), lambda w: F.coalesce(F.element_at(m, w), F.lit(0))))

        return F.when(F.size(s) == 0, F.array_repeat(F.lit(0), len(WORDS))).otherwise(let(F.array_distinct(s), of_kinds))

    return let(runs, lambda r: F.concat(let(F.array_sort(F.filter(r, lambda w: w.isin(*WORDS))), of_found), F.array(F.size(r))))


def class_counts(text: Column) -> Column:
    """counts: of each character class, then of all characters; symbols: how many SYMBOLS.

    Each class is taken out of what the ones before it left, run by run, so only the first goes over the whole text.
    """

    def without(left: Column, classes: list[str], sizes: list[Column]) -> Column:
        if not classes:
            counts = [x - y for x, y in zip(sizes, sizes[1:])]
            return F.struct(F.array(*counts, sizes[0]).alias("counts"), F.regexp_count(left, F.lit(SYMBOLS)).cast("long").alias("symbols"))
        return let(F.regexp_replace(left, classes[0] + "+", ""), lambda rest: without(rest, classes[1:], [*sizes, F.char_length(rest)]))

    return without(text, CLASSES, [F.char_length(text)])


def js_distance(p: list[Column], q: list[float]) -> Column:
    """Jensen-Shannon distance of two distributions, base 2."""
    terms = F.lit(0.0)
    for a, b in zip(p, q):
        m = (a + F.lit(b)) / 2
        terms = terms + F.when(a > 0, a * F.log2(a / m)).otherwise(0.0) + (F.lit(b) * F.log2(F.lit(b) / m) if b > 0 else F.lit(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), terms / 2))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts and both histograms of each text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), windows_repeated(w).alias("n_repeat_words")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), of_words.alias("w"), class_counts(text).alias("c"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), common_counts(text).alias("common"))
    spaces = F.get("c.counts", F.lit(CLASSES.index(BLANK)))  # words are what is left of them
    rows = rows.select("doc_id", "lang", "w.*", (F.get("c.counts", F.lit(len(CLASSES))) - spaces).cast("long").alias("word_chars"), F.col("c.symbols").alias("n_symbols"), "n_dup_lines", F.col("c.counts").alias("classes"), "common")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each language its class and common-word distributions over all documents that pass the base rules. Four rows at most."""
    sums = [F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 1)] + [F.sum(F.get("common", F.lit(k))).alias(f"w{k}") for k in range(len(WORDS) + 1)]
    out = {}
    for r in rows.where(~F.col("base_failed") & F.col("lang").isin(*COMMON)).groupBy("lang").agg(*sums).collect():
        c, w = [r[f"c{k}"] for k in range(len(CLASSES) + 1)], [r[f"w{k}"] for k in range(len(WORDS) + 1)]
        if c[-1] and w[-1]:
            own = [w[WORDS.index(x)] for x in COMMON[r["lang"]]]
            out[r["lang"]] = [x / c[-1] for x in [*c[:-1], c[-1] - sum(c[:-1])]], [x / w[-1] for x in [*own, w[-1] - sum(own)]]
    return out


def distances(rows: DataFrame, refs: dict[str, tuple[list[float], list[float]]]) -> tuple[Column, Column]:
    """The least distance of the class and of the common-word histogram from any reference."""
    classes, words = [], []
    for lang in sorted(refs):
        n = F.greatest(F.get("classes", F.lit(len(CLASSES))), F.lit(1)).cast("double")
        c = [F.get("classes", F.lit(k)) / n for k in range(len(CLASSES))]
        other = (F.get("classes", F.lit(len(CLASSES))) - sum((F.get("classes", F.lit(k)) for k in range(len(CLASSES))), F.lit(0))) / n
        classes.append(js_distance([*c, other], refs[lang][0]))
        n = F.greatest(F.get("common", F.lit(len(WORDS))), F.lit(1)).cast("double")
        own = [F.get("common", F.lit(WORDS.index(x))) for x in COMMON[lang]]
        words.append(js_distance([*[x / n for x in own], (F.get("common", F.lit(len(WORDS))) - sum(own, F.lit(0))) / n], refs[lang][1]))
    return F.array_min(F.array(*classes)), F.array_min(F.array(*words))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, base_failed, class_distance, word_distance and kept of every row."""
    rows = cut(features(docs, id_col, text_col, lang_col))
    refs = references(rows)
    near_c, near_w = distances(rows, refs) if refs else (F.lit(0.0), F.lit(0.0))
    rows = rows.withColumns({"class_distance": near_c, "word_distance": near_w})
    chars, runs = F.get("classes", F.lit(len(CLASSES))), F.get("common", F.lit(len(WORDS)))
    far = (chars >= LEAST_CHARS) & (F.col("class_distance") > MOST_CHARS) | (runs >= LEAST_WORDS) & (F.col("word_distance") > F.lit(MOST_WORDS) + 1 / F.sqrt(runs))
    return rows.withColumn("kept", ~F.col("base_failed") & ~far).drop("classes", "common", "lang")
