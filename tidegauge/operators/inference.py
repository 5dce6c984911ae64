"""Scores of texts by a saved model that every worker loads once, in batches of a fixed size.

The model is a table of words with weights (``word``, ``weight``), saved as
Parquet: what a text scores is the logistic of its words' mean weight. It stands
for any model with a load and a batch step: replace ``Model``.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of a batch, words of a text that count, what stands for a blank text.
BATCH, WORDS, BLANK = 16, 256, "."
WORD = re.compile(r"\w+")
#: Words of a saved model at most: a worker holds it whole.
VOCABULARY = 50_000


class Model:
    """A loaded model; ``loads`` counts how often this process has loaded each path's."""

    loads: Counter[str] = Counter()

    def __init__(self, path: str) -> None:
        files, base = fs.FileSystem.from_uri(path)
        table = ds.dataset(base, filesystem=files, format="parquet").to_table(columns=["word", "weight"])
        self.weights = dict(zip(table["word"].to_pylist(), table["weight"].to_pylist()))
        Model.loads[path] += 1

    def predict(self, texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            found = [self.weights.get(w, 0.0) for w in WORD.findall(t.lower())[:WORDS]]
            out.append(1 / (1 + math.exp(-sum(found) / max(1, len(found)))))
        return out


@functools.lru_cache(maxsize=4)
def loaded(path: str) -> Model:
    return Model(path)


def scores(path: str, batch: int = BATCH) -> Column:
    """A function of a text column: the probability (0 to 1), and how often its process had loaded this model by then."""

    @F.pandas_udf("probability double, loads int")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        for texts in parts:
            texts = [t if isinstance(t, str) and t.strip() else BLANK for t in texts]
            found = [p for at in range(0, len(texts), batch) for p in model.predict(texts[at : at + batch])]
            yield pd.DataFrame({"probability": found, "loads": pd.Series([Model.loads[path]] * len(found), dtype="int32")})

    return score


def fitted(docs: DataFrame, path: str, least: int = 2) -> None:
    """Save the log-odds of words: ``docs`` has text and good (boolean); words of ``least`` documents or more, the most frequent VOCABULARY of them."""
    words = docs.where("good is not null").select("good", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word"))
    n = words.groupBy("word").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    kept = n.where(F.col("g") + F.col("b") >= least).orderBy(F.desc(F.col("g") + F.col("b")), "word").limit(VOCABULARY)
    kept.select("word", F.ln((F.col("g") + 1.0) / (F.col("b") + 1.0)).alias("weight")).coalesce(1).write.parquet(path)
