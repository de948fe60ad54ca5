"""Token counts of whole texts by rank-synchronous array merging.

The pieces and scores of a ``sentencepiece`` BPE model are read once per worker. A text falls into
pre-tokens that no merge can cross; each distinct pre-token is held as a row of one ragged numpy
array of symbols. In every round each row merges its lowest-ranked pair, all rows at once (all
occurrences in the row, or only the leftmost one where a merge could open a better-ranked pair or
ranks tie), until no row has a pair left; the surviving symbols are the tokens, unknown characters
count one token for each UTF-8 byte.

Defined cases: null and empty texts have 0 tokens; repeated rows are counted each; very long
pre-tokens are cut wherever two neighbouring characters occur together in no piece, which no merge
crosses either; an empty table gives no rows; all other columns stay as they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

#: Fixed value: the character that stands for a space in pieces.
BLANK = "▁"
#: Pre-tokens whose counts a worker keeps; beyond that the cache starts afresh.
KEEP = 1_000_000
#: Symbols merged at once (bounds the working arrays).
ROUND_SYMBOLS = 1 << 21
_NONE = np.int64(1 << 40)


class MergeTable:
    """The merges of a model as sorted arrays: symbol pair to merged symbol and rank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        chars = sorted({c for p in pieces for c in p})
        names = chars + [p for p in pieces if len(p) > 1]
        number = {p: i for i, p in enumerate(names)}
        self.char_of = np.full(0x110000, -1, dtype=np.int32)
        self.char_of[[ord(c) for c in chars]] = np.arange(len(chars))
        #: Tokens that a surviving symbol stands for: its bytes if it is no piece.
        self.cost = np.array([1 if p in pieces else len(p.encode()) for p in names], dtype=np.int64)
        scores = sorted({-s for s in pieces.values()})
        rank_of = {-s: i for i, s in enumerate(scores)}
        rank = np.array([rank_of[pieces[p]] if p in pieces else -1 for p in names], dtype=np.int64)
        merges = sorted((number[p[:i]] << 32 | number[p[i:]], number[p]) for p in pieces if len(p) > 1 for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.keys = np.array([k for k, _ in merges] or [0], dtype=np.int64)
        self.to = np.array([v for _, v in merges] or [0], dtype=np.int64)
        self.rank = rank[self.to] if merges else np.array([_NONE])
        # A merge is taken at all its places at once only if its rank is its alone and nothing
        # that it opens outranks it.
        left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
        alone = np.bincount(rank[[number[p] for p in pieces if len(p) > 1]], minlength=len(scores)) == 1 if len(names) > len(chars) else np.zeros(1, bool)
        opens = np.full(len(names), _NONE)
        np.minimum.at(opens, left, self.rank)
        np.minimum.at(opens, right, self.rank)
        self.at_once = alone[np.minimum(self.rank, len(alone) - 1)] & (opens[self.to] > self.rank)
        self.line_feed_apart = not any("\n" in p and len(p) > 1 for p in pieces)
        self.line_feed_cost = 1
        joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.joined = np.array(sorted(int(self.char_of[ord(a)]) << 32 | int(self.char_of[ord(b)]) for a, b in joined) or [-1], dtype=np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of the merge of each symbol pair, -1 for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token, its spaces already written as BLANK."""
        out = np.zeros(len(pretokens), dtype=np.int64)
        size = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        ends = np.cumsum(size)
        at = 0
        while at < len(pretokens):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROUND_SYMBOLS, side="right")))
            out[at:to] = self._merge("".join(pretokens[at:to]), size[at:to])
            at = to
        return out

    def _merge(self, text: str, size: np.ndarray) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        symbol = self.char_of[code].astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        unknown = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
        total = np.bincount(owner[symbol < 0], weights=unknown[symbol < 0], minlength=len(size)).astype(np.int64)
        if len(symbol) == 0:
            return total
        # Rows end with their pre-token and wherever two characters are together in no piece.
        key = symbol[:-1] << 32 | symbol[1:]
        near = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
        stay = (owner[1:] == owner[:-1]) & (self.joined[near] == key) & (symbol[:-1] >= 0) & (symbol[1:] >= 0)
        row = np.r_[0, np.cumsum(~stay)]
        merge = np.full(len(symbol), -1, dtype=np.int64)
        merge[:-1][stay] = self.pairs(symbol[:-1][stay], symbol[1:][stay])
        while len(symbol):
            # rows without a pair are done: their symbols are tokens
            rank = np.where(merge >= 0, self.rank[merge], _NONE)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            length = np.diff(np.r_[first, len(row)])
            best = np.minimum.reduceat(rank, first)
            done = np.repeat(best == _NONE, length)
            if done.any():
                known = done & (symbol >= 0)
                total += np.bincount(owner[known], weights=self.cost[symbol[known]], minlength=len(total)).astype(np.int64)
                live = ~done
                symbol, owner, row, merge, rank = symbol[live], owner[live], row[live], merge[live], rank[live]
                keep = best != _NONE
                length, best = length[keep], best[keep]
                if not len(symbol):
                    break
            least = rank == np.repeat(best, length)
            at = np.flatnonzero(least)
            together = self.at_once[merge[at]]
            lead = np.r_[True, row[at][1:] != row[at][:-1]]  # the leftmost of its row
            # neighbouring pairs share a symbol: of a run, every other one from its left
            run = np.r_[True, (np.diff(at) != 1) | (np.diff(row[at]) != 0)]
            place = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[np.where(together, place % 2 == 0, lead)]
            symbol[at] = self.to[merge[at]]
            gone = np.zeros(len(symbol), dtype=bool)
            gone[at + 1] = True
            changed = np.zeros(len(symbol), dtype=bool)
            changed[at] = True
            live = ~gone
            symbol, owner, row, merge, changed = symbol[live], owner[live], row[live], merge[live], changed[live]
            touched = changed | np.r_[changed[1:], False]
            last = np.r_[row[1:] != row[:-1], True]
            merge[touched & last] = -1
            again = np.flatnonzero(touched & ~last)
            merge[again] = self.pairs(symbol[again], symbol[again + 1])
        return total


class TokenCounter:
    """Counts for Arrow columns; distinct pre-tokens are merged once per worker."""

    def __init__(self, path: str) -> None:
        self.table = MergeTable(path)
        self.known: dict[bytes, int] = {}

    def count(self, column) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = pc.replace_substring(pc.fill_null(column, ""), BLANK, " ")  # both mean the same
        data, offsets = C.flat_bytes(column)
        parts = [self._count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in C.slices(offsets)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(self.known) > KEEP:
            self.known = {}
        n = len(data)
        if not n:
            return np.zeros(len(offsets) - 1, np.int64)
        feed = (data == 0x0A) if self.table.line_feed_apart else np.zeros(n, dtype=bool)
        blank = data == 0x20
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        fresh = edge[:n] | np.r_[True, feed[:-1]] | (blank & ~np.r_[False, blank[:-1]])
        starts = np.flatnonzero(fresh & ~feed)
        stop = edge[1:] | np.r_[feed[1:], True] | (np.r_[blank[1:], False] & ~blank)
        ends = np.flatnonzero(stop & ~feed) + 1
        key = C.span_hashes(data, starts, ends)
        led = edge[starts]  # the first pre-token of a text has the added space
        key ^= led.astype(np.uint64) * C.ROLL
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        view = memoryview(np.ascontiguousarray(data))
        names = [(b" " if lead else b"") + bytes(view[a:b]) for a, b, lead in zip(starts[first].tolist(), ends[first].tolist(), led[first].tolist())]
        new = [x for x in dict.fromkeys(names) if x not in self.known]
        self.known.update(zip(new, self.table.count([x.decode().replace(" ", BLANK) for x in new]).tolist()))
        counts = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))[inverse]
        sums = np.r_[0, np.cumsum(counts)][np.searchsorted(starts, offsets)]
        feeds = np.r_[0, np.cumsum(feed)][offsets]
        out = np.diff(sums) + np.diff(feeds)
        # a text that opens with a line feed has the added space as a pre-token of its own
        opening = offsets[:-1][(np.diff(offsets) > 0)]
        alone = feed[opening]
        if alone.any():
            out[np.flatnonzero(np.diff(offsets) > 0)[alone]] += int(self.table.count([BLANK])[0])
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_count(text: Column, model_path: str) -> Column:
    """Tokens (long) of ``text`` under the sentencepiece BPE model at ``model_path``."""

    @F.arrow_udf("long")
    def tokens(column: pa.Array) -> pa.Array:
        return pa.array(counter(model_path).count(column), pa.int64())

    return tokens(text)


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit added (replacing columns of these names)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": token_count(text, model_path)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
