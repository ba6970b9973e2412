"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: What a template may use; inside texts and roles these strings get a backslash after their first character.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\||</?SYS>>)"
_CLOSING = r"\|(\\*)>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
FORMATTED = "conv_id {kind}, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_starts array<int>, loss_ends array<int>"


def escape(text: str) -> str:
    return re.sub(_CLOSING, r"|\\\1>", re.sub(_CONTROL, r"\1\\\2\3", text))


def unescape(text: str) -> str:
    """The inverse of escape(): one backslash less in every such place."""
    return re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\]|\||</?SYS>>)", r"\1\2\3", re.sub(r"\|\\(\\*)>", r"|\1>", text))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation as one string, and the span of each turn's escaped text in it."""
    parts, spans, at = ["<s>"], [], 3
    for role, text in turns:
        head, body = f"<|{escape(role)}|>\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, "</s>\n")
        at += len(head) + len(body) + 5
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) that render() was given."""
    return [(unescape(m[1]), unescape(m[2])) for m in re.finditer(r"<\|(.*?)\|>\n(.*?)</s>\n", formatted, re.DOTALL)]


def covering(offsets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens. What an encoder trims before a token, such as a blank, counts as the token's."""
    spans = np.array(offsets, np.int64).reshape(-1, 2)
    ends = np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]
    return np.minimum(spans[:, 0], np.r_[0, ends[:-1]][: len(ends)]), ends


def loss_spans(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each token the part of it that lies in the sorted spans, or (0, 0).

    Binary search gives the first token that ends after a span's start and the last that begins before its end.
    A token over the border of a span is cut there; one that meets two spans keeps both ends, with markup between,
    which the template's markers, longer than any gap in a token's trained merges, rule out.
    """
    left, right = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for a, b in spans:
        if a < b:
            i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
            left[i:j], right[i:j] = np.maximum(starts[i:j], a), np.minimum(ends[i:j], b)
    return left, right


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER, loss_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row a conversation: the formatted text, its token ids and the loss mask.

    A token is under the mask where loss_starts < loss_ends: that part of it is text of a turn of loss_role. Turns stand by
    turn (nulls first), then role and text, so that ties have one order; repeated rows stay turns of their own. Null
    roles and texts count as empty; rows without conv_id form one conversation; other columns are ignored; an empty
    table gives no rows. The tokenizer's file is read by the driver and sent along; its size is fixed.
    """
    ship(turns.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        model = turns.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(model.value)
        encoder.encode_special_tokens = True
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for turns in batch.column(1):
                pairs = [(t["role"] or "", t["text"] or "") for t in turns.as_py()]
                text, spans = render(pairs)
                coded = encoder.encode(text, add_special_tokens=False)
                starts, ends = covering(coded.offsets)
                left, right = loss_spans(starts, ends, [s for s, (role, _) in zip(spans, pairs, strict=True) if role == loss_role])
                for column, value in zip(out, (text, coded.ids, starts, ends, left, right), strict=True):
                    column.append(value)
            kinds = [pa.string(), *[pa.list_(pa.int32())] * 5]
            yield pa.record_batch([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["conv_id", "formatted", "ids", "starts", "ends", "loss_starts", "loss_ends"])

    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.mapInArrow(run, FORMATTED.format(kind=turns.schema["conv_id"].dataType.simpleString()))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_conversations(): turns and masked text, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for text, left, right in zip(*(batch.column(k).to_pylist() for k in ("formatted", "loss_starts", "loss_ends")), strict=True):
                turns, parts, at = read_back(text), [], 0
                for a, b in zip(left, right, strict=True):
                    if a < b and b > at:  # tokens of one character share its span
                        parts.append((max(a, at), at := b))
                runs: list[list[int]] = []
                for a, b in parts:
                    if runs and runs[-1][1] == a:
                        runs[-1][1] = b
                    else:
                        runs.append([a, b])
                loss = "".join(unescape(text[a:b]) for a, b in runs)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ship(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped as (
  select *, length(regexp_replace(regexp_replace(t, '([<\[])(\\*)(/?s>|/?INST\]|\||</?SYS>>)', '\1\\\2\3', 'g'), '\|(\\*)>', '|\\\1>', 'g')) n_text,
    length(regexp_replace(regexp_replace(r, '([<\[])(\\*)(/?s>|/?INST\]|\||</?SYS>>)', '\1\\\2\3', 'g'), '\|(\\*)>', '|\\\1>', 'g')) n_role from turns)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (r = 'assistant'), '')) loss_sha256,
  (3 + sum(n_text + n_role + 10))::bigint formatted_chars
from escaped group by conv_id
"""
