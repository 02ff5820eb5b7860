"""Token counts of whole texts without materialising token ids.

The vocabulary of pre-tokens grows far more slowly than the text, so each distinct pre-token is tokenised once. A document's
count is the sum, over its pre-token frequencies, of pieces times frequency.

1. One pass over the texts yields each task's distinct pre-tokens; a shuffle makes them distinct overall, and the tokenizer
   counts the pieces of each. The result is written to the shared folder.
2. A second pass forms the frequencies of each document. The most frequent pre-tokens (``head_rows`` at most) are looked up in
   a bounded broadcast table within the task, so that the words that every document holds are never shuffled; rows of the long
   tail meet the piece table in a shuffle join, which adaptive execution can split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced, text_or_empty

#: Code points on which the regular-expression module and the tokenizer agree (checked in the tests); other texts are split by the tokenizer itself.
AGREED = "\u0000-ԯḀ-⁯₠-₿℀-⯿　-鿯가-힣＀-￯"
#: Rows in one batch handed back to Spark, about.
OUT_ROWS = 50_000


@lru_cache(maxsize=2)
def _tools(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    added = tok.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added) or tok.normalizer is not None:
        raise ValueError("added tokens that take white space in, and normalizers, aren't handled")
    special = regex.compile("(" + "|".join(regex.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) + ")") if added else None
    pattern = regex.compile(PATTERN)
    odd = regex.compile(f"[^{AGREED}]")
    pre = tok.pre_tokenizer

    def pieces_of(text: str) -> list[str]:
        if odd.search(text):
            return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]
        return pattern.findall(text)

    return tok, special, pieces_of


def pretokens(path: str, text: str) -> list[str]:
    """Pre-tokens of a text, with the tokenizer's special strings as pre-tokens of their own."""
    _, special, pieces_of = _tools(path)
    if special is None or not special.search(text):
        return pieces_of(text)
    out: list[str] = []
    for k, part in enumerate(special.split(text)):
        out.extend([part] if k % 2 else pieces_of(part))
    return out


def piece_counts(path: str, words: list[str]) -> list[int]:
    """Number of tokens of each pre-token."""
    tok = _tools(path)[0]
    return [len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False)]


def _distinct(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"pretoken": pa.array(seen.keys(), pa.string()), "docs": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                seen.update(set(pretokens(path, text)))
                if len(seen) > 500_000:
                    yield flush()
        if seen:
            yield flush()

    return run


def _count_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = piece_counts(path, batch.column("pretoken").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), batch.column("docs"), pa.array(n, pa.int64())], ["pretoken", "docs", "pieces"])

    return run


def _frequencies(path: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        rows, ids, sizes, words, ns = [], [], [], [], []

        def flush():
            kinds = (pa.int64(), id_type, pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((rows, ids, sizes, words, ns), kinds, strict=True)], ["row_id", "id", "n_bytes", "pretoken", "n"])
            for x in (rows, ids, sizes, words, ns):
                x.clear()
            return out

        for batch in sliced(batches):
            id_type = batch.column("id").type
            for row, own, size, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "id", "n_bytes", "text")), strict=True):
                total = 0
                for word, n in Counter(pretokens(path, text)).items():
                    k = known.get(word)
                    if k is None:
                        rows.append(row)
                        ids.append(None)
                        sizes.append(0)
                        words.append(word)
                        ns.append(n)
                    else:
                        total += k * n
                rows.append(row)
                ids.append(own)
                sizes.append(size)
                words.append(None)
                ns.append(total)
                if len(rows) > OUT_ROWS:
                    yield flush()
        if rows:
            yield flush()

    return run


def _commonest(vocab: DataFrame, most: int) -> DataFrame:
    """The commonest pre-tokens, at most so many: those from a step of the logarithmic scale of frequencies up, by the counts of its steps."""
    step = F.floor(F.log2("docs") * 8)
    held, least = 0, None
    for s, n in sorted(vocab.groupBy(step.alias("s")).count().collect(), reverse=True):
        held += n
        if held > most:
            break
        least = s
    return vocab.where(F.lit(False) if least is None else step >= least)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, head_rows: int = 200_000) -> DataFrame:
    """Token counts of every row of docs.

    tokenizer: path of a byte-level tokenizer file, readable on every executor. head_rows: bound on the rows of the broadcast table.
    Returns (id_col, n_bytes, n_tokens, over_limit), a row for each row of docs. A null or empty text has 0 bytes and 0 tokens;
    a text of any length is counted whole; a null id stays null; repeated rows (same id, same or other text) each get their own
    row; other columns are ignored; an empty table gives an empty result; the order of rows is open, and nothing hangs on ties. Special strings inside texts count as their single token, as the library does by default.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kinds = texts.select("text").mapInArrow(_distinct(tokenizer), "pretoken string, docs long")
    vocab = materialize(kinds.groupBy("pretoken").agg(F.sum("docs").alias("docs")).mapInArrow(_count_pieces(tokenizer), "pretoken string, docs long, pieces long"), "pieces", 1000)
    head = {w: k for w, k in _commonest(vocab, head_rows).select("pretoken", "pieces").collect()}
    rows = texts.select(F.monotonically_increasing_id().alias("row_id"), "id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = texts.schema["id"].dataType.simpleString()
    freqs = materialize(rows.mapInArrow(_frequencies(tokenizer, spark.sparkContext.broadcast(head)), f"row_id long, id {kind}, n_bytes long, pretoken string, n long"), "frequencies", 1000)
    tail = freqs.where("pretoken is not null").join(vocab.select("pretoken", "pieces"), "pretoken")
    parts = freqs.where("pretoken is null").drop("pretoken").unionByName(tail.select("row_id", "id", "n_bytes", (F.col("n") * F.col("pieces")).alias("n")))
    counts = parts.groupBy("row_id").agg(F.max("id").alias(id_col), F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return counts.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
