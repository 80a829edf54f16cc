"""Token counts by the whole-token shortcut.

Offline, the vocabulary's strings are run through the tokenizer itself; those that are one pre-token and encode alone
as one token are proven whole. While counting, a pre-token that is proven counts one; only the rest is merged, by the
library, and remembered in a table of bounded size. Strings of added tokens split a text before its pre-tokens, as
the library does by default.

Defined cases: a null text counts as empty (0 tokens); doc_id may be null or repeated, each row is counted; a text
with characters that the pre-tokeniser's library may class differently is encoded by the library as a whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.arrow import batched, rows_of
from quire.llm.pretokens import certain, pattern

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

#: Merged pre-tokens that a task remembers besides the proven ones.
MEMO = 300_000


class Counter:
    """Counts one tokenizer file's tokens; ``whole`` are the proven strings."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.whole = whole
        self.table = dict.fromkeys(whole, 1)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None

    def merge(self, pretokens: list[str]) -> None:
        if len(self.table) > len(self.whole) + MEMO:
            self.table = dict.fromkeys(self.whole, 1)
        for p, e in zip(pretokens, self.library.encode_batch_fast(pretokens, add_special_tokens=False)):
            self.table[p] = len(e.ids)

    def count(self, text: str) -> int:
        if not certain(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        total = 0
        if self.added is not None and self.added.search(text):
            total += sum(1 for _ in self.added.finditer(text))
            return total + sum(self.plain(part) for part in self.added.split(text))
        return self.plain(text)

    def plain(self, text: str) -> int:
        found = (m.group() for m in pattern().finditer(text)) if len(text) > 1_000_000 else pattern().findall(text)
        total, found = 0, iter(found)
        while some := list(itertools.islice(found, 500_000)):
            got = list(map(self.table.get, some))
            if None in got:
                self.merge(list({p for p, n in zip(some, got) if n is None}))
                got = list(map(self.table.__getitem__, some)) if all(p in self.table for p in some) else [len(self.library.encode(p, add_special_tokens=False).ids) for p in some]
            total += sum(got)
        return total


def prove_whole(path: str) -> frozenset[str]:
    """Strings of the vocabulary that are a single pre-token and that the tokenizer encodes alone as one token."""
    from tokenizers import Tokenizer, decoders

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(path)
    added = {t.content for t in library.get_added_tokens_decoder().values()}
    bytes_of = decoders.ByteLevel()
    strings = {bytes_of.decode([piece]) for piece in library.get_vocab(with_added_tokens=False)}
    strings = sorted(s for s in strings if s and "�" not in s and s not in added and certain(s) and pattern().fullmatch(s) and pattern().match(s).group() == s)
    return frozenset(s for s, e in zip(strings, library.encode_batch_fast(strings, add_special_tokens=False)) if len(e.ids) == 1)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens). The proven set, bounded by the vocabulary, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(prove_whole(path))

    def count(batches):
        if path not in _counters:
            _counters[path] = Counter(path, shared.value)
        counter = _counters[path]

        def rows():
            for batch in batches:
                for key, body in rows_of(batch, "doc_id", "text"):
                    body = body or ""
                    yield key, len(body.encode()), counter.count(body)

        yield from batched(rows(), SCHEMA)

    return docs.selectExpr(f"cast({doc_id} as bigint) as doc_id", f"cast({text} as string) as text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
