"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter trigram is bound from the vectors of its letters, each
rotated by its place; a text bundles (adds) its trigram vectors; a language prototype bundles the texts of the language. A text gets the
language whose prototype has the largest cosine with it.

Trigrams lie inside words, with one space before and after each word. A text is counted first and bound after, so a trigram vector is
made once per slice of texts and bundling is one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import bounded_batches, held_out, query, table

DIMENSIONS = 1024
SLICE = 1 << 18  # code points bundled at a time
SPACE = 32
#: More labels than any list of languages has; beyond it the prototypes would not be a small table.
MOST_LANGUAGES = 10_000
UNKNOWN = "und"


def letter_bits() -> np.ndarray:
    return np.packbits([chr(c).isalpha() for c in range(0x110000)])


class Letters:
    """The random vectors of letters, drawn when first met, and which code points are letters (packed bits). A task makes its own."""

    def __init__(self, dimensions: int = DIMENSIONS, bits: np.ndarray | None = None):
        self.dimensions, self.drawn = dimensions, {}
        self.is_letter = np.unpackbits(letter_bits() if bits is None else bits, count=0x110000).astype(bool)

    def vector(self, code: int) -> np.ndarray:
        if code not in self.drawn:
            self.drawn[code] = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.drawn[code]


def _slices(texts: list[str | None], most: int) -> Iterator[tuple[list[int], list[str], list[tuple[bool, bool]]]]:
    """Texts (or parts of long ones) in groups of about ``most`` code points, with the numbers of the texts.

    Long texts are cut at spaces. Where there is none a part begins two code points before the end of the last one, and it is told
    that the trigrams around the last code point of the one and the first of the other do not count: each is met whole in the other part.
    """
    at, parts, inner, size = [], [], [], 0
    for i, text in enumerate(texts):
        start, goes_on = 0, False
        while text and start < len(text):
            end, broken = len(text), False
            if end - start > most:
                end = text.rfind(" ", start + 1, start + most) + 1
                broken = not end
                end = end or start + most
            at.append(i)
            parts.append(text[start:end].lower())
            inner.append((goes_on, broken))
            size += end - start
            start, goes_on = end - 2 if broken else end, broken
            if size >= most:
                yield at, parts, inner
                at, parts, inner, size = [], [], [], 0
    if parts:
        yield at, parts, inner


def bundle(texts: list[str | None], known: Letters, most: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and whether it has a letter."""
    dimensions = known.dimensions
    vectors, lettered = np.zeros((len(texts), dimensions), np.float32), np.zeros(len(texts), bool)
    for at, parts, inner in _slices(texts, most):
        codes = np.frombuffer(" ".join(["", *parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.array([*at, at[-1]]), [len(p) + 1 for p in parts] + [1])
        owner = np.concatenate([owner[:1], owner])[: len(codes)]
        counts = np.ones(len(codes), bool)
        begin = 1
        for p, (goes_on, broken) in zip(parts, inner):
            if goes_on:
                counts[begin] = False
            if broken:
                counts[begin + len(p) - 1] = False
            begin += len(p) + 1
        letters = known.is_letter[codes]
        keep = letters | np.concatenate([[True], letters[:-1]])  # one space after each run of letters
        codes, owner, letters, counts = np.where(letters, codes, SPACE)[keep], owner[keep], letters[keep], counts[keep]
        lettered[owner[letters]] = True
        alphabet, small = np.unique(codes, return_inverse=True)
        middle = np.flatnonzero((letters & counts)[1:-1]) + 1  # a trigram around every letter
        if not len(middle):
            continue
        base = len(alphabet)
        grams = (small[middle - 1] * base + small[middle]) * base + small[middle + 1]
        found, gram = np.unique(grams, return_inverse=True)
        rows, row = np.unique(owner[middle], return_inverse=True)
        letter = np.stack([known.vector(int(c)) for c in alphabet])
        bound = np.roll(letter, 2, 1)[found // base // base] * np.roll(letter, 1, 1)[found // base % base] * letter[found % base]
        counts = np.bincount(row * len(found) + gram, minlength=len(rows) * len(found)).reshape(len(rows), len(found))
        vectors[rows] += counts.astype(np.float32) @ bound.astype(np.float32)
    return vectors, lettered


def train_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A unit prototype per language, from every row with a text and a language. No such row: no prototype."""
    bounded_batches(docs.sparkSession)
    bits = letter_bits()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        known = Letters(dimensions, bits)
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            vectors, lettered = bundle(b.column(0).to_pylist(), known)
            for lang in set(langs[lettered]):
                total[lang] = total.get(lang, 0) + vectors[(langs == lang) & lettered].sum(0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                                             ["lang", "sums"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    parts = rows.mapInArrow(sums, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("place", "part"))
    by_lang = parts.groupBy("lang", "place").agg(F.sum("part").alias("part"))
    rows = by_lang.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "part")))["part"].alias("sums"))  # ``dimensions`` numbers each
    out: dict[str, np.ndarray] = {}
    for r in rows.limit(MOST_LANGUAGES + 1).toLocalIterator():
        out[r.lang] = np.array(r.sums)
    if len(out) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(out.items())}


def language_of(prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS):
    """A column function: text -> struct(lang, score, lettered). The score is the cosine, 0 where it is negative.

    * Null text or a text without a letter: ``und``, score 0, not ``lettered``. Where nothing was learned every text is ``und`` with score 0, and
      ``lettered`` still tells the texts with letters.
    * Long texts are read whole, a slice at a time. Ties go to the first language in order of names.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, dimensions), np.float32)

    bits = letter_bits()

    @F.arrow_udf("struct<lang:string,score:double,lettered:boolean>")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Letters(dimensions, bits)
        for t in texts:
            vectors, lettered = bundle(t.to_pylist(), known)
            if names and len(vectors):
                cosine = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                best = cosine.argmax(1)
                score = np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                lang = [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist())]
            else:
                score, lang = np.zeros(len(t)), [UNKNOWN] * len(t)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score.astype(np.float64)), pa.array(lettered, pa.bool_())],
                                             ["lang", "score", "lettered"])
    return judge


@query("op7_language_id")
def op7_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    judge = language_of(train_languages(docs.filter(~held_out("doc_id", 3, 1))))
    out = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), judge("text").alias("_judged"))
    return out.select("doc_id", "held_out", F.col("_judged.lang").alias("lang_pred"), F.col("_judged.score").alias("score"))
