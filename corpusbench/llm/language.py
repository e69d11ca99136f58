"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusbench.llm.common import text_blocks, without_nulls

PROFILE, LONGEST, UNKNOWN = 400, 3, "und"
_BLOCK = 256 << 10
_BITS = 21  # of a code point; three fit one number


def learn_profiles(
    documents: DataFrame, *, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The ``size`` most frequent n-grams of each language over all given documents: lang, gram, place from 0.

    Every n-gram of every text counts; tasks add up their own before the shuffle.  Ties are put in the
    order of the n-grams' numbers.  Texts or languages that are null teach nothing.
    """
    named = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = named.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = chosen.mapInArrow(_count, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1)
    return ranked.where(F.col("place") < size).select("lang", "gram", "place")


def predict(
    documents: DataFrame, profiles: DataFrame, *, size: int = PROFILE, text_col: str = "text"
) -> DataFrame:
    """``documents`` with lang_pred and score, the profile of least out-of-place distance.

    The ``size`` most frequent n-grams of a text are ranked; each adds the difference between its
    place and its place in a language's profile, or ``size`` where the profile lacks it.  The score is
    1 less the distance as a share of the largest one.  Ties take the first language by name.  A text
    that is null or has no letter, or any text without profiles, is ``und`` with score 0.  Columns
    named lang_pred or score are replaced.  The profiles, ``size`` rows for each language, are read
    by the driver.
    """
    rows = profiles.orderBy("lang", "place").collect()
    languages = sorted({r.lang for r in rows})
    grams = np.unique(np.array([r.gram for r in rows], np.int64))
    places = np.full((len(grams) + 1, len(languages)), size, np.int32)
    number = {name: k for k, name in enumerate(languages)}
    for r in rows:
        places[np.searchsorted(grams, r.gram), number[r.lang]] = r.place
    kept = documents.select([c for c in documents.columns if c not in ("lang_pred", "score")])
    answer = F.arrow_udf(_answers(languages, grams, places, size), "lang_pred string, score double")
    told = kept.withColumn("_answer", answer(F.col(text_col)))
    return told.select(*kept.columns, "_answer.lang_pred", "_answer.score")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: one in four by the checksum of its id; a null id never is."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


# ---------------------------------------------------------------- n-grams


class Letters:
    """Lower-cased letters of texts as numbers, with one 0 before, between and after words."""

    def __init__(self):
        self.table = np.fromiter((k if chr(k).isalpha() else 0 for k in range(0x110000)), np.int32, 0x110000)

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams of the texts and the number of n-grams before each text."""
        lowered = ["\n" + t.lower() + "\n" for t in texts]
        sizes = np.array([len(t) for t in lowered], np.int64)
        codes = self.table[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        kept = np.ones(len(codes), bool)
        kept[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (text[1:] != text[:-1])
        codes, text = codes[kept], text[kept]
        one = codes
        two = (codes[:-1] << _BITS) | codes[1:]
        three = (two[:-1] << _BITS) | codes[2:]
        same2 = text[1:] == text[:-1]
        same3 = same2[1:] & same2[:-1]
        # A gram that starts with a letter keeps its length in its number; a leading 0 is marked.
        mark = np.int64(1) << np.int64(62)
        parts = [
            (one[one != 0], text[one != 0]),
            ((two | np.where(codes[:-1] == 0, mark, 0))[same2], text[:-1][same2]),
            ((three | np.where(codes[:-2] == 0, mark, 0))[same3], text[:-2][same3]),
        ]
        grams, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(owner, kind="stable")
        return grams[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _counts(sorted_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.diff(sorted_grams, prepend=-1))
    return sorted_grams[new], np.diff(np.append(new, len(sorted_grams)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = Letters()
    for batch in batches:
        langs, numbers = np.unique(batch.column(0).to_pylist(), return_inverse=True)
        column = without_nulls(batch, "text")
        held: list[list] = [[] for _ in langs]
        for first, _, offsets in text_blocks(column, _BLOCK):
            rows = len(offsets) - 1
            grams, before = letters.grams(column.slice(first, rows).to_pylist())
            owner = np.repeat(numbers[first : first + rows], np.diff(before))
            for k in np.unique(owner):
                held[k].append(_counts(np.sort(grams[owner == k])))
        for name, parts in zip(langs, held, strict=True):
            if not parts:
                continue
            grams, numbers_of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = np.bincount(numbers_of, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(name)] * len(grams)), pa.array(grams), pa.array(sums)], ["lang", "gram", "n"]
            )


def _answers(languages: list[str], known: np.ndarray, places: np.ndarray, size: int):
    def distances(grams: np.ndarray) -> np.ndarray:
        own, counts = _counts(np.sort(grams))
        if len(own) > size:
            least = np.partition(counts, len(counts) - size)[len(counts) - size]
            own, counts = own[counts >= least], counts[counts >= least]
        ranked = own[np.lexsort((own, -counts))[:size]]
        at = np.minimum(np.searchsorted(known, ranked), len(known) - 1)
        row = np.where(known[at] == ranked, at, len(known))
        there = places[row]
        away = np.where(there < size, np.abs(there - np.arange(len(ranked))[:, None]), size)
        return away.sum(axis=0) / (size * len(ranked))

    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = Letters()
        for column in batches:
            names, scores = [], []
            for first, _, offsets in text_blocks(column.fill_null(""), _BLOCK):
                grams, before = letters.grams(column.slice(first, len(offsets) - 1).fill_null("").to_pylist())
                for low, high in zip(before[:-1], before[1:], strict=True):
                    if low == high or not languages or not (grams[low:high] < 1 << _BITS).any():
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    away = distances(grams[low:high])
                    best = int(np.argmin(away))
                    names.append(languages[best])
                    scores.append(float(1 - away[best]))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    answer.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return answer
