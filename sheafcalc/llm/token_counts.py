"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at safe boundaries into pieces and encoded in batches of about equal bytes. A boundary
is safe where the tokenizer drops white space and never joins across it, so the lengths of the pieces
add up to the length of the whole text. Each distinct piece of a batch is encoded once; a worker keeps
the lengths of short pieces, up to a bound. Empty and null texts have no tokens; repeated rows are
counted each; other columns are left alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text encoded by one call.
BATCH_CHARS = 1 << 17
#: Lengths that a worker keeps, and the longest piece it keeps one for.
KEPT, KEPT_CHARS = 500_000, 40
LIMIT = 2048


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file, once per Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=4)
def splits_at_blanks(path: str) -> bool:
    """Whether blanks and line ends are safe boundaries: words are split off and white space is dropped
    before encoding, and no added token holds white space or takes any from its sides."""
    if path.endswith(".model"):
        return False  # sentencepiece keeps blanks as parts of tokens
    conf = json.loads(tokenizer(path).to_str())
    pre = conf.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    drops = any(x.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") and "\\s" in str(x.get("pattern"))) for x in steps[:1])
    plain = all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not any(c.isspace() for c in x["content"]) for x in conf.get("added_tokens", []))
    return bool(drops and plain)


@lru_cache(maxsize=4)
def kept_lengths(path: str) -> dict[str, int]:
    return {"": 0}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(pieces: list[str], path: str, batch_chars: int) -> list[int]:
    """Lengths of the pieces, encoded in batches of about batch_chars characters."""
    tok, out, i = tokenizer(path), [], 0
    while i < len(pieces):
        j, size = i, 0
        while j < len(pieces) and (j == i or size + len(pieces[j]) <= batch_chars):
            size += len(pieces[j])
            j += 1
        if path.endswith(".model"):
            out += map(len, tok.encode(pieces[i:j], num_threads=1))
        else:
            out += map(len, tok.encode_batch_fast(pieces[i:j], add_special_tokens=False))
        i = j
    return out


def lengths(texts: list[str | None], path: str, batch_chars: int = BATCH_CHARS) -> np.ndarray:
    if not splits_at_blanks(path):
        return np.array(encoded([t or "" for t in texts], path, batch_chars), np.int64)
    kept, out, i = kept_lengths(path), np.zeros(len(texts), np.int64), 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and size <= 8 * batch_chars:
            size += len(texts[j] or "")
            j += 1
        parts = [t.replace("\n", " ").split(" ") if t else () for t in texts[i:j]]
        words = set().union(*parts)
        if len(kept) + len(words) > KEPT:
            kept.clear()
            kept[""] = 0
        new = list(words - kept.keys())
        got = dict(zip(new, encoded(new, path, batch_chars), strict=True))
        kept.update(got)
        out[i:j] = [sum(map(kept.__getitem__, p)) for p in parts]
        for k in got:
            if len(k) > KEPT_CHARS:
                del kept[k]
        i = j
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit."""
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = lengths(b.column(1).to_pylist(), path, batch_chars)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = own.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
