"""Token counts of whole texts: Arrow batches in, lengths out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices

#: UTF-8 bytes handed to the tokenizer at once, and characters beyond which a text is split.
BATCH_BYTES = 1 << 20
SEGMENT = 1 << 16


def splits_at_space(model) -> bool:
    """Whether no piece of the vocabulary has a space after another character.

    Merges then never cross from a character to a space behind it, and the space that the model puts before
    every text stands for the one cut away, so lengths of the segments add up exactly.
    """
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    prefix = [p for p in model.encode("a", out_type=str)][:1]
    return all("▁" not in p.lstrip("▁") for p in pieces) and prefix[0].startswith("▁") and len(model.encode("a  ")) > len(model.encode("a"))


def segments(text: str, limit: int = SEGMENT) -> Iterator[str]:
    """Cut a long text before single spaces; a stretch without a safe space stays whole."""
    start, n = 0, len(text)
    while n - start > limit:
        cut = text.find(" ", start + limit)
        while cut > 0 and (text[cut - 1] in " ▁" or cut == n - 1):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def counter(model_file: str, batch_bytes: int, limit: int):
    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        safe = splits_at_space(model)
        for batch in slices(batches, 1024):
            ids, texts = batch.column(0), batch.column(1)
            n_bytes, n_tokens = [], [0] * len(texts)
            waiting: list[str] = []
            owner: list[int] = []
            held = 0

            def flush():
                for row, tokens in zip(owner, model.encode(waiting, num_threads=1), strict=True):
                    n_tokens[row] += len(tokens)
                waiting.clear()
                owner.clear()

            for row, value in enumerate(texts):
                text = value.as_py() or ""
                size = len(text.encode())
                n_bytes.append(size)
                for part in segments(text, limit) if safe and len(text) > limit else (text,):
                    waiting.append(part)
                    owner.append(row)
                    held += len(part)
                    if held >= batch_bytes:
                        flush()
                        held = 0
            flush()
            yield pa.record_batch([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, segment: int = SEGMENT) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens; no row is moved between tasks.

    model_file is a sentencepiece model at the same path on every worker. Within a task texts are
    encoded in batches of about `batch_bytes`; texts longer than `segment` are cut where the
    vocabulary proves the cut exact. Only lengths leave the worker.

    Defined cases: null and empty texts count 0 bytes and 0 tokens; null ids and repeated rows stay
    as they are; an empty table gives an empty result; other columns play no part.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(counter(model_file, batch_bytes, segment), f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
