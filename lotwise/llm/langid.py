"""Language identification: nearest of several clustered centroids per language over TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Hash dimensions of the n-gram vectors.
DIMENSIONS = 1 << 12
#: Labelled documents of a language that its centroids are fitted on, at most about so many, chosen by a hash of the id.
MOST_FITTED = 2_000
CENTROIDS = 3
#: Languages are classes that the driver holds.
MOST_LANGUAGES = 10_000
#: A text whose cosine to the nearest centroid is below this share of that centroid's own members' 1st percentile is rejected.
SLACK = 0.8
_ROUNDS = 8
_PIECE = 1 << 20
#: As Java's \\p{L}, which the rows to learn from are chosen by: digits of other kinds, such as \xb2 or \u2167, are none.
_LETTER = regex.compile(r"\p{L}")
#: Letters become lower case, other ASCII a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """Counts of hashed byte pairs and triples of the whole text, words apart by one space."""
    data = b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    out = np.zeros(DIMENSIONS, np.float64)
    for i in range(0, len(data), _PIECE):  # overlapping by two bytes
        b = np.frombuffer(data, np.uint8, min(_PIECE + 2, len(data) - i), i).astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        if i:  # the pair across the border was counted in the piece before
            two = two[1:]
        for codes, salt in ((two, 0x9E3779B1), (three, 0x85EBCA77)):
            out += np.bincount((codes * np.uint32(salt)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0): log term frequency times inverse document frequency."""
    m = np.log1p(np.stack([counts(t) for t in texts])) * idf
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm, norm, 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task hold each dimension; dimension -1: how many texts there are."""
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for b in batches:
        for t in b.column(0):
            df += counts(t.as_py()) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.r_[n, df])], names=["d", "n"])


def _cluster(idf: np.ndarray, k: int):
    """Spherical k-means on the bounded sample of one language; farthest-first start, so the result is determined."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = vectors(rows.sort_values(["pick", "text"])["text"].tolist(), idf)
        mean = x.mean(axis=0)
        centres = [x[np.argmax(x @ mean)]]
        while len(centres) < min(k, len(x)):
            centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, axis=1))])
        c = np.stack(centres)
        for _ in range(_ROUNDS):
            own = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        sims = x @ c.T
        own = np.argmax(sims, axis=1)
        low = [float(np.quantile(sims[own == i, i], 0.01)) if (own == i).any() else 0.0 for i in range(len(c))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "low": low})
    return run


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """idf, and for each centroid its language, vector and its members' low cosine.

    Document frequencies are counted over all given documents; centroids are fitted on a bounded sample a language.
    """
    pick = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 30))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), pick.alias("pick"))
    seen = dict(rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect())
    if len(seen) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    summed = rows.select("text").mapInArrow(_frequencies, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    df = {r["d"]: r["n"] for r in summed}
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(DIMENSIONS)]))) + 1
    part = {lang: int(min(1.0, MOST_FITTED / n) * (1 << 30)) for lang, n in seen.items()}
    if not part:
        return idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0)
    limits = rows.sparkSession.createDataFrame(sorted(part.items()), "lang string, part long")
    sample = rows.join(F.broadcast(limits), "lang").where("pick < part").select("lang", "text", "pick")
    found = sample.groupBy("lang").applyInPandas(_cluster(idf, CENTROIDS), "lang string, centroid binary, low double").collect()
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    return idf, [r["lang"] for r in found], np.array([np.frombuffer(r["centroid"], np.float32) for r in found]).reshape(-1, DIMENSIONS), np.array([r["low"] for r in found])


def predict(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    idf, langs, centroids, low = model
    shared = docs.sparkSession.sparkContext.broadcast((idf, langs, centroids, low))  # centroids x dimensions, bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centroids, low = shared.value
        for b in batches:
            names, scores, near = [], [], []
            for i in range(0, b.num_rows, 256):
                texts = [t.as_py() for t in b.column(2).slice(i, 256)]
                known = [j for j, t in enumerate(texts) if t and langs and _LETTER.search(t)]
                sims = vectors([texts[j] for j in known], idf) @ centroids.T if known else np.zeros((0, len(langs)))
                part: list = [("und", 0.0, False)] * len(texts)
                for j, s in zip(known, sims):
                    best = int(np.argmax(s))
                    score = min(max(float(s[best]), 0.0), 1.0)
                    part[j] = (langs[best], round(score, 6), bool(score >= SLACK * low[best]))
                for column, values in zip((names, scores, near), zip(*part)):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(near, pa.bool_())], names=["id", "held_out", "lang_pred", "score", "accepted"])

    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    rows = docs.select(F.col(id_col).alias("id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def identify_languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicts the language of every text from centroids learnt on the rows with crc32(id) mod 4 other than 2.

    Texts become vectors of hashed byte pairs and triples of their lower-cased words, weighted by log frequency and
    inverse document frequency, of length 1. Each language has up to three centroids (spherical k-means); the nearest
    by cosine decides. ``accepted`` tells whether the text is near enough to it, by what its own members keep to.

    Columns: id, held_out, lang_pred (``und`` where the text is null or has no letter, or no language could be
    learnt), score (cosine, 0 to 1; 0 for und), accepted. A null id is hashed as an empty string. Rows are judged
    alone; ties go to the first language by name. An empty table gives an empty result; extra columns are ignored.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2
    return predict(docs, fit(docs.where(~held), lang_col, id_col, text_col), id_col, text_col, held)
