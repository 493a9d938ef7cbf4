"""Operator 5: token counts of whole texts, by overlap resynchronisation.

A text longer than ``chunk`` characters is encoded in overlapping chunks with offsets. Two neighbours are
spliced at a white-space character inside their overlap: no token reaches over white space (the
pre-tokenizer drops it, the normalizer changes it only into white space, added tokens hold none), so
the tokens on either side are those of the whole text. Both encodings must have no token across the place and
must agree on the tokens next to it; where there is no such place the overlap is widened, at last to the whole
rest of the text. Only counts are kept, so a text needs the memory of one chunk.

Defined results: null texts have no bytes and no tokens, as empty ones; rows are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches, table

CHUNK, OVERLAP, LIMIT = 1 << 15, 1 << 9, 2048
_SPACE = " \n\t\r"
_loaded: dict = {}


def load(path: str):
    """The tokenizer of a file, once a worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            t = _loaded[path] = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
    return _loaded[path]


def _spans(tokenizer, text: str, base: int) -> list[tuple[int, int]]:
    return [(a + base, b + base) for a, b in tokenizer.encode(text, add_special_tokens=False).offsets]


def splice_place(text: str, lo: int, hi: int, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> int | None:
    """The last white space strictly inside (lo, hi) at which both encodings break and agree on what follows."""
    for at in range(hi - 2, lo, -1):
        if text[at] not in _SPACE:
            continue
        if any(a < at < b for a, b in left[-64:]) or any(a < at < b for a, b in right[:4096]):
            continue
        # The tokens between the previous white space and here lie whole in both chunks.
        back = at - 1
        while back > lo and text[back] not in _SPACE:
            back -= 1
        if back <= lo:
            return None
        if [x for x in left if back < x[0] and x[1] <= at] == [x for x in right if back < x[0] and x[1] <= at]:
            return at
    return None


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    total, start, lead = 0, 0, 0  # tokens from start on are open; the current chunk begins at lead <= start
    end = min(len(text), chunk)
    current = _spans(tokenizer, text[lead:end], lead)
    while end < len(text):
        wide, at = overlap, None
        while True:
            begin = max(start, end - wide)
            after = min(len(text), end + chunk)
            following = _spans(tokenizer, text[begin:after], begin)
            at = splice_place(text, begin, end, current, following)
            if at is not None or begin == start:
                break
            wide *= 4
        if at is None:  # no white space at all: the chunk grows instead
            end = min(len(text), end + max(chunk, end - lead))
            current = _spans(tokenizer, text[lead:end], lead)
            continue
        total += sum(1 for a, b in current if a >= start and b <= at)
        start, lead, end, current = at, begin, after, following
    return total + sum(1 for a, _ in current if a >= start)


def count_tokens(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: the key, n_bytes, n_tokens, over_limit."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer)
        spliced = not tokenizer.endswith(".model")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk or not spliced]
            for k in range(0, len(short), 64):
                part = short[k : k + 64]
                if spliced:
                    found = [len(e) for e in tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)]
                else:
                    found = [len(e) for e in tok.encode([texts[i] for i in part], num_threads=1)]
                for i, n in zip(part, found, strict=True):
                    counts[i] = n
            for i, t in enumerate(texts):
                if spliced and len(t) > chunk:
                    counts[i] = count_long(tok, t, chunk, overlap)
            sizes = [len(t.encode()) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
