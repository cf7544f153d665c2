"""Language identification with a string kernel, Nystrom landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
#: A-Z folded; other bytes of the UTF-8 text as they are.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] = _FOLD[97:123]
PIECE = 1 << 20
#: An n-gram is known when one in so many training texts holds it.
KNOWN_IN = 200


def _grams(text: bytes, longest: int) -> Iterator[np.ndarray]:
    """Hashed n-grams of 1 to ``longest`` bytes of the whole text, below 2 ** BITS, a length and a piece of the text at a time."""
    for at in range(0, len(text), PIECE):
        raw = _FOLD[np.frombuffer(text, dtype=np.uint8)[at : at + PIECE + longest - 1]]
        code = np.zeros(len(raw), dtype=np.uint32)
        for n in range(longest):
            if len(raw) <= n:
                break
            code = code[: len(raw) - n] * np.uint32(257) + raw[n:] + np.uint32(1)
            yield (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def spectrum(text: bytes, longest: int) -> np.ndarray:
    """Distinct hashed n-grams, as sorted numbers."""
    seen = np.zeros(1 << BITS, dtype=bool)
    for grams in _grams(text, longest):
        seen[grams] = True
    return np.flatnonzero(seen).astype(np.int32)


def known_share(text: bytes, longest: int, known: np.ndarray) -> float:
    """The share of the text's n-grams, each as often as it occurs, that are known: it does not fall with a text's length."""
    hits = [(int(known[grams].sum()), len(grams)) for grams in _grams(text, longest)]
    return sum(h for h, _ in hits) / max(1, sum(n for _, n in hits))


@dataclass(frozen=True)
class Classifier:
    """Languages, the weight of each n-gram for each language, and which n-grams are known: those that one training text
    in KNOWN_IN holds, or more. Its size is fixed by 2 ** BITS and the languages."""

    langs: tuple[str, ...]
    weights: np.ndarray
    longest: int
    known: np.ndarray

    def score(self, spectra: list[np.ndarray]) -> np.ndarray:
        """Ridge outputs of texts given by their spectra, by one matrix product."""
        present = np.zeros((len(spectra), 1 << BITS), dtype=np.float32)
        for i, s in enumerate(spectra):
            present[i, s] = 1
        size = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
        return (present @ self.weights) / size


def fit(spectra: list[np.ndarray], langs: list[str], landmarks: int, ridge: float, longest: int) -> Classifier:
    """The kernel of two texts is their number of common n-grams over the root of their numbers' product.

    Landmarks are taken in turn from the languages, and at least two of each where it has them. With K the kernel of texts and landmarks and M that of landmarks,
    the Nystrom features are K M^(-1/2); ridge regression on them, +1 for the language and -1 for the rest, gives a
    weight to each landmark, and as the kernel is linear in presence these sum to a weight for each n-gram.
    """
    names = sorted(set(langs))
    by = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    chosen = [by[n][k] for k in range(max(map(len, by.values()), default=0)) for n in names if k < len(by[n])][: max(landmarks, 2 * len(names))]
    marks = np.zeros((len(chosen), 1 << BITS), dtype=np.float32)
    for row, i in enumerate(chosen):
        marks[row, spectra[i]] = 1 / np.sqrt(max(1, len(spectra[i])))
    kernel = np.stack([marks[:, s].sum(axis=1) / np.sqrt(max(1, len(s))) for s in spectra]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-8 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    features = np.hstack([kernel @ half])
    goal = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = np.array([1 / len(by[x]) for x in langs])[:, None]  # languages count alike
    beta = np.linalg.solve(features.T @ (weight * features) + ridge * np.eye(features.shape[1]), features.T @ (weight * goal))
    held = np.bincount(np.concatenate(spectra), minlength=1 << BITS)
    return Classifier(tuple(names), (marks.T.astype(np.float64) @ (half @ beta)).astype(np.float32), longest, held * KNOWN_IN >= max(1, len(spectra)))


def train(labelled: DataFrame, per_language: int = 300, landmarks: int = 96, ridge: float = 1e-3, longest: int = 4, most_languages: int = 256) -> Classifier | None:
    """Fit on (text, lang) with non-null lang: about ``per_language`` different texts of each language, by a hash of the text.

    The bound on what is fitted, and on what reaches the driver, is per_language texts of each of the ``most_languages``
    languages with the most different texts (ties by name), and about a third more before the cut; a text is drawn when its hash
    lies under its language's share, and the first per_language by hash are used. Equal texts of one language are drawn
    as one, so neither repeated ids nor repeated rows move the bound. Only spectra are collected.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("hash"))
    texts = rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in texts.orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return None
    span = 1 << 30
    draw = F.pmod(F.xxhash64("hash", F.lit("draw")), F.lit(span))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(span * min(1.0, 1.3 * per_language / n)))])
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < F.element_at(share, F.col("lang"))).groupBy("lang", "hash", "draw").agg(F.first("text").alias("text")).select("text", "lang", "draw")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spectra = [spectrum(t, longest) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(spectra, pa.list_(pa.int32())), b.column(1), b.column(2)], ["spectrum", "lang", "draw"])

    found = drawn.mapInArrow(task, "spectrum array<int>, lang string, draw long").toArrow().combine_chunks()
    if not found.num_rows:
        return None
    lists = found["spectrum"].chunk(0)
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    spectra = [flat[ends[i] : ends[i + 1]] for i in range(len(lists))]
    langs, draws = found["lang"].to_pylist(), found["draw"].to_pylist()
    used, of = [], {}
    for i in sorted(range(len(langs)), key=lambda i: (langs[i], draws[i], spectra[i].tobytes())):
        of[langs[i]] = of.get(langs[i], 0) + 1
        if of[langs[i]] <= per_language:
            used.append(i)
    return fit([spectra[i] for i in used], [langs[i] for i in used], landmarks, ridge, longest)


def predict(docs: DataFrame, model: Classifier | None, text_col: str = "text", with_known: bool = False) -> DataFrame:
    """docs with lang_pred and score (0 to 1) of the whole text; "und" and 0 where it is null or has no letter.

    Columns of docs that have the names made here are replaced; others are kept, whatever their names. Repeated rows
    are predicted each by itself; an empty table gives an empty result.

    The score is the winning ridge output carried from -1..1 to 0..1, cut at the ends. ``with_known`` adds lang_known, the
    ``known_share`` of the text, which tells texts in no learned language.
    """
    made = ("lang_pred", "score", *(["lang_known"] if with_known else []))
    taken = [c for c in docs.columns if c.lower() not in made]
    held = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(taken)], F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    if model is None:
        return held.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(taken)], F.lit("und").alias("lang_pred"), *[F.lit(0.0).alias(c) for c in made[1:]])
    place, letters = taken.index(text_col), len(taken)
    schema = docs.select(*[F.col(f"`{c}`") for c in taken], F.lit("").alias("lang_pred"), *[F.lit(0.0).alias(c) for c in made[1:]]).schema
    names = schema.names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                texts, good = b.column(place).cast(pa.binary()), b.column(letters).to_pylist()
                asked = [i for i, g in enumerate(good) if g]
                langs, scores, shares = ["und"] * len(good), [0.0] * len(good), [0.0] * len(good)
                if asked:
                    out = model.score([spectrum(texts[i].as_py(), model.longest) for i in asked])
                    for i, row in zip(asked, out, strict=True):
                        best = int(row.argmax())
                        langs[i], scores[i] = model.langs[best], float(min(1.0, max(0.0, (row[best] + 1) / 2)))
                        if with_known:
                            shares[i] = known_share(texts[i].as_py(), model.longest, model.known)
                more = [pa.array(x, pa.float64()) for x in (scores, shares)[: len(made) - 1]]
                yield pa.RecordBatch.from_arrays([*b.columns[:letters], pa.array(langs, pa.string()), *more], names)

    return held.mapInArrow(task, schema)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(id_col, text, held_out, lang_pred, score): learns from documents that are not held out, predicts for all.

    Held out are ids whose crc32, as text, leaves 1 when divided by 3; a null id is neither held out nor learned from.
    The language column is read in training alone. Without a single labelled row all texts are "und".
    Repeated rows are predicted alike; empty tables give empty results; other columns are ignored.
    """
    out = F.coalesce(held_out(F.col(id_col)), F.lit(False))
    known = docs.where(F.col(id_col).isNotNull() & ~out).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), out.alias("held_out"))
    return predict(asked, train(known, **options)).withColumnRenamed("doc_id", id_col)


def op8_language(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")


SQL: dict[str, str] = {}
QUERIES = {"op8_language": op8_language}
