"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

Sentences are the examples. A sentence is made of units: its words, and the pairs of neighbours that may be phrases. The kernel of two units is
the sum over all strings of three letters u of phi_u(x) phi_u(z), where phi_u(x) sums DECAY to the number of skipped letters over
the places where u is in x as a subsequence of at most REACH letters, divided by a function of the unit's length. So an insult with
letters put in between still shares most subsequences with itself. Marks for the ends of a unit are letters too; signs and the space
of a pair are taken out first, and three or more single letters in a row are one word.

Training. Sentences take the label of their document. Every sentence of a clean document is to score low. A toxic document has
at least one sentence that is to score high (its witness), which stands for it by its highest unit; so do words and pairs that are in too many
toxic documents and no clean one for chance. Landmarks are the units of the first witnesses, by the log-odds of their subsequences, and the clean
words most like them. Units become vectors of kernel values with the landmarks times K^(-1/2), a linear squared-hinge machine
is fitted by Newton steps, and witnesses and the hardest clean sentences are chosen anew for ROUNDS rounds. Witnesses with one letter put in stand
beside the plain ones.

Phrases. Toxic documents whose words score no higher than those of most clean ones are searched for pairs of neighbours that too many of them have for chance, and no clean
document has; these are learned as units in a second training. A pair is looked in any text if each of its words has a kernel of at least PART with such a pair's word at that place, so gapped phrases count too.

Scoring. A kernel expansion over landmarks is linear in phi, so the machine is one table of weights for three letters. A sentence scores as its
highest unit and a text as its highest sentence, through the logistic; whole texts count, and the words of a task are kept in a bounded dictionary.

The sample for fitting is bounded: TOXIC and CLEAN labelled documents of at most LONGEST characters, the least by a hash of doc_id.

Results for odd inputs: a null or empty text scores as a text whose words share nothing with any landmark; without labels of
both kinds all texts score 0; repeated rows keep rows of their own; null ids are held in; null labels are not used; of labels that repeat an id the
greatest counts, and of texts that do the least; letters of all scripts count, without spaces between words the whole run is one word (looked
at in overlapping parts); an empty table gives no rows. Only the id and text columns are read for scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import emptied, filled, released, task_memory

DECAY, REACH = 0.6, 6
LETTERS = 26
LANDMARKS = 256
ROUNDS = 5
TOXIC, CLEAN, LONGEST = 1500, 3500, 20_000
CACHED_WORDS = 300_000
SKIPS = [(a, b) for a in range(1, REACH) for b in range(1, REACH - a)]
SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
SIGNS = re.compile(r"[\W_]+")
SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")
END = 63
PART = 0.6

_codes = np.zeros(0x32000, "i4")  # up to the last plane of letters
for _c in range(len(_codes)):
    if chr(_c).isalpha():
        _codes[_c] = _c - 96 if 97 <= _c <= 122 else 27 + _c % 36


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if SPACED.search(text):
        text = SPACED.sub(lambda m: "".join(m[0].split()), text)
    return text.split()


def lettered(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words as numbers with end marks (0: none, or not a letter), and which word each row is of; long words are several rows that overlap."""
    rows, of = [], []
    for k, w in enumerate(words):
        if not w.isalpha():
            w = SIGNS.sub("", w)
        if len(w) <= LETTERS:
            rows.append(w)
            of.append(k)
        else:
            for a in range(0, len(w) - LETTERS // 2, LETTERS // 2):
                rows.append(w[a : a + LETTERS])
                of.append(k)
    points = np.array(rows, f"U{LETTERS}").view("<u4").reshape(len(rows), LETTERS)
    out = np.zeros((len(rows), LETTERS + 2), "i4")
    out[:, 1:-1] = _codes[np.minimum(points, len(_codes) - 1)]
    out[:, 0] = END
    sizes = (points > 0).sum(axis=1)
    out[np.arange(len(rows)), sizes + 1] = END
    return out, np.array(of, "int64")


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each way to skip: the three-letter numbers at each place (0 where a part isn't a letter), and their weight."""
    for a, b in SKIPS:
        n = codes.shape[1] - a - b
        x, y, z = codes[:, :n], codes[:, a : a + n], codes[:, a + b :]
        yield np.where((x > 0) & (y > 0) & (z > 0), x << 12 | y << 6 | z, 0), DECAY ** (a + b - 2)


def norms(codes: np.ndarray) -> np.ndarray:
    n = (codes > 0).sum(axis=1)
    return np.sqrt(np.maximum(1e-9, sum(np.maximum(0, n - a - b) * DECAY ** (2 * (a + b - 2)) for a, b in SKIPS)))


def weighed(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum of table over a word's subsequences, by its norm. table[0] is 0."""
    total = np.zeros(len(codes))
    for t, weight in triples(codes):
        total += weight * table[t].sum(axis=1)
    return total / norms(codes)


@dataclass
class Model:
    table: np.ndarray
    bias: float
    middle: float
    slope: float
    #: Places of three-letter numbers in the columns of `parts`: the first words of phrases, then the second ones.
    places: np.ndarray | None = None
    parts: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), -np.inf)
        for k in range(0, len(units), 20_000):
            codes, of = lettered(units[k : k + 20_000])
            np.maximum.at(out, of + k, weighed(codes, self.table) + self.bias)
        return out

    def looks(self, words: list[str]) -> np.ndarray:
        """Bits for each word: 1 if it is like the first word of a phrase, 2 if like the second."""
        out = np.zeros(len(words), "int64")
        if self.parts is not None:
            for k in range(0, len(words), 20_000):
                codes, of = lettered(words[k : k + 20_000])
                for bit, marks in enumerate(self.parts, 1):
                    np.bitwise_or.at(out, of + k, bit * (_kernel(codes, self.places, marks).max(axis=1) >= PART))
        return out

    def probability(self, raw: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (raw - self.middle), -30, 30))))


NOTHING = Model(np.zeros(1 << 18, "f4"), -1e9, 0.0, 1.0)


def sentences_of(text: str | None) -> list[list[str]]:
    return [w for s in SENTENCE.split(text or "") if (w := words_of(s))]


@dataclass
class Split:
    """A text as numbers of its words, and where its sentences start and end in them."""

    words: np.ndarray
    edges: np.ndarray

    def pairs(self) -> np.ndarray:
        """Neighbours within a sentence, each pair as one number: the first word's times 2^32 and the second's."""
        inside = np.ones(len(self.words), bool)
        inside[self.edges[1:] - 1] = False
        at = np.flatnonzero(inside)
        return self.words[at].astype("i8") << 32 | self.words[at + 1]


def _numbered(texts: list[str | None]) -> tuple[list[str], list[Split]]:
    """The different words in the order in which they come up, and the texts by numbers of words: a text takes four bytes a word."""
    number: dict[str, int] = {}
    split = []
    for t in texts:
        own = sentences_of(t)
        split.append(Split(np.array([number.setdefault(w, len(number)) for s in own for w in s], "i4"), np.cumsum([0] + [len(s) for s in own], dtype="i4")))
    return list(number), split


def _odds(words: list[str], split: list[Split], labels: np.ndarray) -> np.ndarray:
    """Log-odds of each three-letter subsequence by the documents it is in."""
    df = np.ones((2, 1 << 18))
    for doc, y in zip(split, labels.tolist()):
        codes, _ = lettered([words[k] for k in np.unique(doc.words).tolist()])
        df[int(y), np.unique(np.concatenate([t.ravel() for t, w in triples(codes) if w >= DECAY]))] += 1
    table = np.log(df[1] / (labels.sum() + 2)) - np.log(df[0] / (len(labels) - labels.sum() + 2))
    table[0] = 0
    return np.maximum(table, -2).astype("f4")


def _kernel(codes: np.ndarray, places: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel values of words with the landmarks. places: column of each three-letter number in marks' transpose."""
    out = np.zeros((len(codes), marks.shape[1]))
    for k in range(0, len(codes), 500):
        part = codes[k : k + 500]
        for t, weight in triples(part):
            at = places[t]
            rows, cols = np.nonzero(at)
            np.add.at(out, rows + k, weight * marks[at[rows, cols]])
        out[k : k + 500] /= norms(part)[:, None]
    return out


def _machine(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machine by Newton steps. y: -1 or 1."""
    whole = np.ones((len(x), x.shape[1] + 1))
    whole[:, :-1] = x
    x = whole
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        active = y * (x @ w) < 1
        a, c = x[active], weights[active]
        new = np.linalg.solve(a.T @ (a * c[:, None]) + np.diag(penalty), a.T @ (c * y[active]))
        step = 1.0
        loss = lambda v: (penalty * v * v).sum() + (weights * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
        before = loss(w)
        while step > 1e-3 and loss(w + step * (new - w)) > before + 1e-12:
            step /= 2
        if np.abs(new - w).max() < 1e-7:
            break
        w = w + step * (new - w)
    return w[:-1], float(w[-1])


def _gapped(word: str, found: int, rng: np.random.Generator) -> list[str]:
    """The word with a letter put in, or a sign in place of one, at each inner place if it was found often, else at one."""
    inner = range(1, len(word)) if len(word) > 3 else []
    places = list(inner) if found >= 5 else [int(rng.choice(inner))] if inner else []
    letter = lambda: "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]
    return [word[:k] + letter() + word[k:] for k in places] + [word[:k] + "0" + word[k + 1 :] for k in places if found >= 5 and k < len(word) - 1]


def _marks(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each three-letter number stands (0: nowhere) and the normed phi of the units, a column each."""
    codes, of = lettered(names)
    codes = codes[np.unique(of, return_index=True)[1]]
    used = np.unique(np.concatenate([t.ravel() for t, _ in triples(codes)]))
    used = used[used > 0]
    places = np.zeros(1 << 18, "int64")
    places[used] = np.arange(1, len(used) + 1)
    marks = np.zeros((len(used) + 1, len(codes)), "f4")
    for t, weight in triples(codes):
        rows, cols = np.nonzero(places[t])
        np.add.at(marks, (places[t][rows, cols], rows), weight)
    marks /= norms(codes)[None, :]
    marks[0] = 0
    return places, marks


def _in_documents(split: list[Split], y: np.ndarray, n: int) -> tuple[np.ndarray, Counter]:
    """In how many clean and how many different toxic documents each of n words is; those of toxic ones in the order in which they come up."""
    clean, bad, seen = np.zeros(n, "int64"), Counter(), set()
    for doc, label in zip(split, y.tolist()):
        own, first = np.unique(doc.words, return_index=True)
        if not label:
            clean[own] += 1
        elif (key := own.tobytes()) not in seen:
            seen.add(key)
            bad.update(doc.words[np.sort(first)].tolist())
    return clean, bad


def _sure(clean: np.ndarray, bad: Counter, share: float) -> list[int]:
    """What is in too many toxic documents, and never in clean ones, for chance."""
    return [u for u, n in bad.items() if not clean[u] and n * np.log(share) < np.log(0.01 / len(clean))]


def _phrases(words: list[str], split: list[Split], y: np.ndarray, model: Model) -> list[tuple[int, int]]:
    """Pairs of neighbours that explain toxic documents whose words don't: never in clean ones, the most frequent first, each for documents that the earlier ones left."""
    raw = model.raw(words)
    high = np.array([raw[d.words].max() for d in split])
    usual = np.quantile(high[y == 0], 0.95)
    pairs_in = [frozenset(np.unique(d.pairs()).tolist()) for d, label, x in zip(split, y, high) if label and x <= usual]
    candidates = set().union(*pairs_in)
    some = np.array(sorted(candidates), "i8")
    clean = {p for d, label in zip(split, y) if not label for p in np.intersect1d(d.pairs(), some).tolist()}
    named = lambda p: (words[p >> 32], words[p & 0xFFFFFFFF])
    tries, out = max(1, len(candidates)), []
    while pairs_in:
        counts = Counter(p for own in set(pairs_in) for p in own if p not in clean)
        n = max(counts.values(), default=0)
        if n * np.log(y.mean()) >= np.log(0.01 / tries) or len(out) == LANDMARKS // 4:
            break
        pair = min((p for p, m in counts.items() if m == n), key=named)
        out.append((pair >> 32, pair & 0xFFFFFFFF))
        pairs_in = [own for own in pairs_in if pair not in own]
    return out


def fit(texts: list[str | None], labels: list[int], seed: int = 1) -> Model:
    words, split = _numbered(texts)
    keep = [k for k, d in enumerate(split) if len(d.words)]
    split, y = [split[k] for k in keep], np.array(labels, "int64")[keep]
    if not (0 < y.sum() < len(y)):
        return NOTHING
    model = _fit(words, split, y, [], seed)
    phrases = _phrases(words, split, y, model)
    return _fit(words, split, y, phrases, seed) if phrases else model


def _with_phrases(words: list[str], split: list[Split], looks: np.ndarray) -> tuple[list[str], list[Split], np.ndarray]:
    """Units, texts by numbers of units (the pairs of a sentence that may be phrases at its end), and the unit of each word. Units are in the order in which they come up."""
    unit, number, units, out = np.full(len(words), -1), {}, [], []
    for doc in split:
        own, edges = [], [0]
        for a, b in zip(doc.edges.tolist(), doc.edges[1:].tolist()):
            s = doc.words[a:b]
            for k in s.tolist():
                if unit[k] < 0:
                    unit[k] = len(units)
                    units.append(words[k])
            own += unit[s].tolist()
            for k in np.flatnonzero((looks[s[:-1]] & 1 > 0) & (looks[s[1:]] & 2 > 0)).tolist():
                pair = f"{words[s[k]]} {words[s[k + 1]]}"
                if pair not in number:
                    number[pair] = len(units)
                    units.append(pair)
                own.append(number[pair])
            edges.append(len(own))
        out.append(Split(np.array(own, "i4"), np.array(edges, "i4")))
    return units, out, unit


def _fit(words: list[str], split: list[Split], y: np.ndarray, phrases: list[tuple[int, int]], seed: int) -> Model:
    rng = np.random.default_rng(seed)
    clean, bad = _in_documents(split, y, len(words))
    sure = _sure(clean, bad, y.mean())
    model = Model(_odds(words, split, y), 0.0, 0.0, 1.0)
    units, inside = words, split
    if phrases:
        places, marks = _marks([words[k] for p in phrases for k in p])
        model.places, model.parts = places, (marks[:, ::2], marks[:, 1::2])
        codes = [a << 32 | b for a, b in phrases]
        found = Counter(p for doc, label in zip(split, y) if label for p in np.intersect1d(doc.pairs(), codes).tolist())
        units, inside, unit = _with_phrases(words, split, model.looks(words))
        number = {u: k for k, u in enumerate(units) if " " in u}
        bad = Counter({int(unit[k]): n for k, n in bad.items()})
        sure = [int(unit[k]) for k in sure]
        for (a, b), code in zip(phrases, codes):
            if (k := number.get(f"{words[a]} {words[b]}")) is not None:
                bad[k] += found[code]
                sure.append(k)
    in_clean = np.zeros(len(units), "int64")
    for doc, label in zip(inside, y.tolist()):
        if not label:
            in_clean[np.unique(doc.words)] += 1
    toxic, fine = [d for d, label in zip(inside, y) if label], [d for d, label in zip(inside, y) if not label]

    def tops(doc: Split, raw: np.ndarray) -> np.ndarray:
        """The highest unit of each sentence, sentences in falling order."""
        high = raw[doc.words]
        own = doc.words[[a + int(np.argmax(high[a:b])) for a, b in zip(doc.edges.tolist(), doc.edges[1:].tolist())]]
        return own[np.argsort(-raw[own], kind="stable")]

    scores = np.where(in_clean > 0, -9.0, model.raw(units))
    witness = [int(tops(d, scores)[0]) for d in toxic]
    times = np.array([bad[k] for k in range(len(units))])
    first = list(dict.fromkeys(sorted(sure, key=lambda k: -times[k])[: LANDMARKS // 4] + [w for w, _ in Counter(witness).most_common(LANDMARKS // 2)]))
    seen = np.flatnonzero(in_clean)
    hard_order = seen[np.argsort(-model.raw([units[k] for k in seen]), kind="stable")]
    landmarks = first + hard_order[: LANDMARKS - len(first) - LANDMARKS // 8].tolist() + np.argsort(-in_clean, kind="stable")[: LANDMARKS // 8].tolist()
    places, marks = _marks([units[k] for k in dict.fromkeys(landmarks)])
    used = np.flatnonzero(places)
    codes, of = lettered([units[k] for k in dict.fromkeys(landmarks)])
    values, vectors = np.linalg.eigh(_kernel(codes[np.unique(of, return_index=True)[1]], places, marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    negatives = set(hard_order[:2000].tolist()) | set(rng.choice(seen, min(2000, len(seen)), replace=False).tolist())
    features: dict[str, np.ndarray] = {}

    def vectors_of(names: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(names) if w not in features]
        if new:
            c, own = lettered(new)
            c = c[np.unique(own, return_index=True)[1]]
            features.update(zip(new, (_kernel(c, places, marks) @ root).astype("f4")))
        return np.array([features[w] for w in names])

    for _ in range(ROUNDS):
        found = Counter(units[k] for k in witness)
        found.update({units[k]: int(times[k]) for k in sure})
        gapped = [(g, 1.5 * min(n, 25) ** 0.5 / len(gaps)) for w, n in found.items() if (gaps := _gapped(w, n, rng)) for g in gaps]
        less = [units[k] for k in sorted(negatives)]
        names = [*found, *(g for g, _ in gapped), *less]
        target = np.array([1.0] * (len(found) + len(gapped)) + [-1.0] * len(less))
        weights = np.array([np.sqrt(n) for n in found.values()] + [v for _, v in gapped] + [1.0] * len(less))
        w, bias = _machine(vectors_of(names), target, weights)
        table = np.zeros(1 << 18, "f4")
        table[used] = marks[1:] @ (root @ w)
        model = Model(table, bias, 0.0, 1.0, model.places, model.parts)
        raw = model.raw(units)
        witness = [int(tops(d, raw)[0]) for d in toxic]
        for d in fine:
            negatives.update(tops(d, raw)[:2].tolist())
    high, low = np.array([raw[d.words].max() for d in toxic]), np.array([raw[d.words].max() for d in fine])
    edges = np.unique(np.concatenate([high, low]))
    middles = (edges[1:] + edges[:-1]) / 2 if len(edges) > 1 else edges
    errors = np.array([(high < m).mean() + (low >= m).mean() for m in middles])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    model.middle = float(middles[best[np.argmax((edges[1:] - edges[:-1])[best])]] if len(edges) > 1 else edges[0])
    model.slope = 4.0 / max(1e-3, float(np.median(high) - model.middle))
    return model


def fold(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5)), F.lit(1))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list, list]:
    """Texts and labels of the bounded sample that is learned from, outside of the held-out fold."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold(F.col("id")) != 0)).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    usable = texts.where(F.char_length("text").between(1, LONGEST)).select("id").distinct()
    own = own.join(usable, "id", "left_semi")
    some = own.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(TOXIC).unionByName(own.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(CLEAN))
    own = texts.where(F.char_length("text").between(1, LONGEST)).join(F.broadcast(some), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = own.orderBy(F.xxhash64("id"), "id").collect()  # at most TOXIC + CLEAN
    return [r["text"] for r in rows], [r["y"] for r in rows]


def _rated(model: Model, texts: list[str | None], known: dict[str, tuple[float, int]]) -> list[list[float]]:
    """The raw score of each sentence of each text, by its highest unit. known: the words of this task so far, each with its score and what it looks like."""
    out = []
    for k in range(0, len(texts), 500):
        split = [sentences_of(t) for t in texts[k : k + 500]]
        new = [w for w in set().union(*(s for doc in split for s in doc)) if w not in known]
        fresh = dict(zip(new, zip(model.raw(new).tolist(), model.looks(new).tolist()))) if new else {}
        if len(known) + len(fresh) <= CACHED_WORDS:
            known.update(fresh)
            of = known.__getitem__
        else:
            of = lambda w: fresh[w] if w in fresh else known[w]
        pairs: dict[tuple[str, str], float] = {}
        if model.parts is not None:
            for doc in split:
                for s in doc:
                    likes = [of(w)[1] for w in s]
                    pairs.update(((s[n], s[n + 1]), 0.0) for n, (a, b) in enumerate(zip(likes, likes[1:])) if a & 1 and b & 2)
            if pairs:
                pairs = dict(zip(pairs, model.raw([" ".join(p) for p in pairs]).tolist()))
        for doc in split:
            out.append([max([of(w)[0] for w in s] + ([pairs[p] for p in zip(s, s[1:]) if p in pairs] if pairs else [])) for s in doc])
    return out


def _of_texts(model: Model, texts: list[str | None], known: dict) -> list[float]:
    return [model.probability(max(own, default=model.bias)) for own in _rated(model, texts, known)]


def sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence (from 0, those with words), words, score of every sentence: what a text's score comes from."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[float, int]] = {}
        with task_memory(known):
            for batch in batches:
                for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                    rows = [(doc, n, " ".join(s), shared.value.probability(x)) for n, (s, x) in enumerate(zip(sentences_of(text), _rated(shared.value, [text], known)[0]))]
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "sentence", "words", "score"])

    rows = docs.select(filled(F.col(id_col)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, sentence int, words string, score double").withColumn("doc_id", emptied(F.col("doc_id")))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[float, int]] = {}
        with task_memory(known):
            for batch in batches:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "score": _of_texts(shared.value, batch["text"].tolist(), known)})

    rows = docs.select(filled(F.col(id_col)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInPandas(run, "doc_id long, score double").withColumn("doc_id", emptied(F.col("doc_id")))
    return made.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learned(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    texts, found = sample(docs, labels, **columns)
    released(docs.sparkSession)  # the driver holds the heap that the sample took no longer while it fits
    with task_memory():  # the driver's
        return fit(texts, found)


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[float, int]] = {}
        with task_memory(known):
            for texts in batches:
                yield pd.Series(_of_texts(shared.value, texts.tolist(), known), dtype="float64")

    return docs.where(score(F.col(text_col).cast("string")) < 0.5)
