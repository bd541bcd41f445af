"""An encoder's place: texts to token vectors, with a model that tasks load once.

A model is a function of texts that gives for each text its tokens as (token, start, stop, vector), in order; special tokens
have no place (start = stop) and are masked. What comes out is what attention.pool and tokens.evidence_spans take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[list[tuple[str, int, int, list[float]]]]]
#: Fixed value: so many tokens of a text are encoded, special ones included.
LONGEST = 128


@lru_cache(maxsize=2)
def loaded(name: str) -> Model:
    """The model that a function "package.module:function" makes; a worker keeps it from task to task."""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)()


def encode(docs: DataFrame, model: str, batch: int = 64, longest: int = LONGEST) -> DataFrame:
    """doc_id, pos, token, s, e (exclusive), real (false: masked), vector of each token of docs (doc_id, text).

    Texts go to the model `batch` at a time; tokens from `longest` on are cut off, as the encoder reads no more. A null or
    blank text has no rows. A model may fail: then its batch has no rows, and its texts count as not encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(model)
        for rows in batches:
            for k in range(0, len(rows), batch):
                part = rows.slice(k, batch)
                try:
                    made = encoder(part.column(1).to_pylist())
                except Exception as e:  # noqa: BLE001  a model's failure is a result here
                    print(f"not encoded: {e}")
                    continue
                flat = [(i, p, *t) for i, tokens in enumerate(made) for p, t in enumerate(tokens[:longest])]
                ids = part.column(0).take(pa.array([f[0] for f in flat], pa.int64()))
                columns = [pa.array([f[j] for f in flat], t) for j, t in ((1, pa.int32()), (2, pa.string()), (3, pa.int32()), (4, pa.int32()))]
                real, vectors = pa.array([f[4] > f[3] for f in flat], pa.bool_()), pa.array([f[5] for f in flat], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([ids, *columns, real, vectors], ["doc_id", "pos", "token", "s", "e", "real", "vector"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").where(F.col("text").rlike(r"\S"))
    return texts.mapInArrow(run, f"doc_id {kind}, pos int, token string, s int, e int, real boolean, vector array<float>")


def sample_model() -> Model:
    """A model for trying things out: words cut into pieces of four letters, a vector of eight numbers from their letters."""
    import regex

    def vector(piece: str) -> list[float]:
        return [sum(ord(c) * (k + 3) % 17 for c in piece) / 17 / len(piece) - 0.5 for k in range(8)]

    def run(texts: list[str]) -> list[list[tuple[str, int, int, list[float]]]]:
        out = []
        for text in texts:
            tokens = [("[CLS]", 0, 0, [0.0] * 8)]
            for m in regex.finditer(r"\p{L}+", text):
                for k in range(m.start(), m.end(), 4):
                    piece = text[k : min(k + 4, m.end())]
                    tokens.append(("##" * (k > m.start()) + piece, k, k + len(piece), vector(piece)))
            out.append(tokens)
        return out

    return run
