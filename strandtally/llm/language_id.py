"""Language identification with hyperdimensional profiles.

Each of ``SYMBOLS`` letters has a random vector of ``DIM`` signs. A trigram's vector binds (element
by element) its letters' vectors, permuted by two, one and no steps, so that their order counts. A
text's vector bundles (adds) those of its trigrams, a language's prototype those of its training
texts. A text's language is that of the prototype with the largest cosine.

Letters are folded to lower case; a-z are letters of their own, other letters share the remaining
symbols by their code point; everything else is a space, and runs of spaces are one.

Bundling adds up, so each task sends one sum per language and the prototypes are sums of these.
They are the only thing that is sent to all workers: ``DIM`` numbers a language, for at most
``max_languages`` languages (more raise an error).

Cases: a null text or one without letters gets ``und`` and score 0; a null language is not learned
from; with nothing to learn from all texts get ``und``; ties go to the language that sorts first;
rows of equal id are judged each on its own; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.llm.textscan import give_back, pieces, take_turn

SYMBOLS = 40
DIM = 512
UNKNOWN = "und"


@functools.cache
def symbol_table() -> np.ndarray:
    """The symbol of each code point; 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return out


@functools.cache
def trigram_vectors() -> np.ndarray:
    """Signs of all trigrams, a row each."""
    letters = np.random.default_rng(8).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
    a, b, c = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
    return (a[:, None, None, :] * b[None, :, None, :] * c[None, None, :, :]).reshape(SYMBOLS**3, DIM)


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the trigrams in a text, and how often each occurs."""
    symbols = symbol_table()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not symbols.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = np.concatenate([[0], symbols, [0]]).astype(np.int64)
    symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
    counts = np.bincount((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:])
    which = np.flatnonzero(counts)
    return which, counts[which]


def bundle(which: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of trigram vectors, each taken so many times; a few MB of vectors at a time."""
    total = np.zeros(DIM)
    for at in range(0, len(which), 2048):
        total += counts[at : at + 2048].astype(np.float32) @ trigram_vectors()[which[at : at + 2048]].astype(np.float32)
    return total


def profile(text: str | None) -> np.ndarray | None:
    which, counts = trigram_counts(text)
    return bundle(which, counts) if len(which) else None


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = 1000) -> dict[str, np.ndarray]:
    """Unit prototype of each language."""

    def run(batches):
        take_turn("language", trigram_vectors.cache_clear)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            counts: dict[str, np.ndarray] = {}
            for part in pieces(batch):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    which, n = trigram_counts(text)
                    if len(which):
                        counts.setdefault(lang, np.zeros(SYMBOLS**3, np.int64))[which] += n
            for lang, n in counts.items():
                which = np.flatnonzero(n)
                sums[lang] = sums.get(lang, 0) + bundle(which, n[which])
        lang = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([sums[k] for k in lang], pa.list_(pa.float64()))], ["lang", "v"])
        give_back()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    total = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("v"))
    found = total.orderBy("lang").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return {r.lang: (v := np.array(r.v)) / max(np.linalg.norm(v), 1e-12) for r in found}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text"):
    """A column: struct of lang_pred and score (the cosine, 0 at least) of a text column."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIM)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        take_turn("language", trigram_vectors.cache_clear)
        lang, score = [], []
        for text in (t.as_py() for t in texts):
            v = profile(text) if names else None
            if v is None:
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            cosines = matrix @ v / max(float(np.linalg.norm(v)), 1e-12)
            best = int(np.argmax(cosines))
            lang.append(names[best])
            score.append(min(1.0, max(0.0, float(cosines[best]))))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict(F.col(text_col).cast("string"))


def held_out(doc_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls into the fold."""
    return F.coalesce(F.crc32(F.col(doc_col).cast("string")) % folds == fold, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = learn(docs.where(~held_out("doc_id", 3, 1)))
    return docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), identify(docs, prototypes).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
