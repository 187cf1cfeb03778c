"""Token counts with a shortcut for pre-tokens that are one token.

Once per worker every string of the vocabulary is encoded alone; those that give back one token, and
that the pre-tokenizer leaves whole, are proven.  A pre-token among them counts one without any merge,
and only the others are merged.  Counts are kept for each stretch of text seen (see ``bpe``), so a
repeated stretch costs one lookup.

Cases: null and empty texts have no tokens.  Strings of added tokens inside a text are found as the
library does by default.  Texts of any length are taken whole, a few million characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oscilla.llm.bpe import Memo, load, specials, vocabulary
from oscilla.llm.common import slices, texts_of


@lru_cache(maxsize=2)
def proven(path: str) -> frozenset[str]:
    """Strings that are one pre-token and encode alone as one token."""
    tokenizer, strings = load(path), []
    for raw in vocabulary(path):
        try:
            strings.append(raw.decode())
        except UnicodeDecodeError:  # part of a character: never a whole pre-token
            continue
    cut, special = tokenizer.pre_tokenizer.pre_tokenize_str, specials(path)
    alone = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(
        s for s, e in zip(strings, alone, strict=True) if len(e.ids) == 1 and s not in special and len(cut(s)) == 1
    )


@lru_cache(maxsize=2)
def counter(path: str) -> Memo:
    import regex
    from public_tokenizers import PATTERN

    whole, tokenizer, special = proven(path), load(path), specials(path)
    cut = regex.compile(PATTERN).findall

    def learn(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = special and any(x in "\n".join(texts) for x in special)
        held = [[t] if marked and any(x in t for x in special) else cut(t) for t in texts]
        rest = list(set(chain.from_iterable(held)) - whole)
        merged = dict(zip(rest, (len(e) for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        counts = [sum([merged.get(p, 1) for p in ps]) for ps in held]
        return np.array(counts, np.uint32), np.ones(len(texts), np.int64)

    return Memo(learn, special)


def count_tokens(docs: DataFrame, path: str, text: str = "text", ident: str = "doc_id", limit: int = 512) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = counter(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            n = np.zeros(len(texts), np.int64)
            for a, b in slices(texts):
                values, counts = memo.values(texts[a:b])
                sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                ends = np.cumsum(counts)
                n[a:b] = sums[ends] - sums[ends - counts]
            size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    schema = StructType().add("id", rows.schema["id"].dataType).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return rows.mapInArrow(run, schema)
