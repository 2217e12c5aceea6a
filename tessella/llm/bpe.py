"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Words are the matches of the tokenizer's pattern. Words that a worker hasn't met yet become token-position rows
(word, position, token), at first one for each byte. A recursive query joins neighbouring tokens with the merge
table and contracts each word's leftmost pair of minimum rank until no pair is left. Decoding joins the ids with
the vocabulary and puts the bytes together by an ordered aggregation.

A new word is first cut wherever no token of the vocabulary can reach across, which its neighbouring bytes tell: no
merge ever crosses such a place, so its pieces contract on their own, and runs of unspaced scripts fall into short pieces
that come back again and again. Pieces of more than ``LONG`` bytes are contracted in parts of ``LONG``, and a seam between two
parts holds if its last and first token, put together, contract to just these two: then no merge of the whole crosses it,
since whatever pair crossed it first would stand, with the same rank and at the same turn, between the two tokens alone.
Tokens around a seam that doesn't hold are contracted anew together, with new seams at both sides, until all hold, so
the work grows with the length.

Where most seams keep failing (long runs of one letter, whose merges follow from their first byte), all places of the
minimum-rank pair are contracted in one step where that is the same: merging to token c can be followed by a pair of lower
rank only if c stands in a merge of a lower rank than its own, and such merges are contracted one at a time. Such a query makes
as many steps as keep it below ``ROWS`` rows, and what is unfinished then is fed to it again.

Defined cases: a null text is empty: no ids, and decodes to no bytes; ids outside the vocabulary raise an error;
extra columns pass through, and columns named like the outputs are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 48
#: Rows that a query of long pieces makes at most, and its steps at most; bytes of pieces given to it together.
ROWS, STEPS = 4_000_000, 64
TOGETHER = 50_000
#: Tokens at each side of a seam that are contracted anew, at first and at most; rounds after which most seams must hold.
NEAR, FAR, PATIENCE = 4, 24, 6
#: Words, and pieces of words, that a worker remembers in each of two generations. No result depends on it.
REMEMBERED = 80_000
#: Ids decoded by one query.
DECODED_AT_ONCE = 250_000

_CONTRACT_LEFTMOST = """
WITH RECURSIVE state(w, step, ids) AS (
  SELECT w, 0, ids FROM tokens
  UNION ALL
  SELECT state.w, step + 1, list_concat(list_append(ids[1:spot - 1], merged), ids[spot + 2:])
  FROM state JOIN (
    SELECT w, best // 4294967296 AS merged, best % 4294967296 AS spot
    FROM (
      SELECT w, min(m.merged * 4294967296 + pos) AS best
      FROM (SELECT w, ids, unnest(generate_series(1, len(ids) - 1)) AS pos FROM state) t
      JOIN merges m ON m.l = t.ids[pos] AND m.r = t.ids[pos + 1]
      GROUP BY w
    )
  ) chosen ON chosen.w = state.w
)
SELECT w, arg_max(ids, step) AS ids FROM state GROUP BY w
"""
_CONTRACT_ALL_PLACES = """
WITH RECURSIVE state(w, step, pos, id) AS (
  SELECT w, 0, pos, id FROM tokens
  UNION ALL
  SELECT w, step + 1, pos, CASE WHEN hit THEN merged ELSE id END
  FROM (
    WITH paired AS MATERIALIZED (
      SELECT s.w, s.step, s.pos, s.id, m.merged, m.alone
      FROM (
        SELECT w, step, pos, id, lead(id) OVER (PARTITION BY w ORDER BY pos) AS next FROM state WHERE step < {steps}
      ) s LEFT JOIN merges m ON m.l = s.id AND m.r = s.next
    ), best AS (
      SELECT w, min(merged * 4294967296 + pos) AS best FROM paired WHERE merged IS NOT NULL GROUP BY w
    )
    SELECT *, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
    FROM (
      SELECT *, CASE WHEN NOT same THEN false WHEN alone THEN merged * 4294967296 + pos = best
                ELSE row_number() OVER (PARTITION BY w, same, place - nth ORDER BY pos) % 2 = 1 END AS hit
      FROM (
        SELECT *, row_number() OVER (PARTITION BY w, same ORDER BY pos) AS nth
        FROM (
          SELECT p.*, best, coalesce(merged = best // 4294967296, false) AS same, row_number() OVER (PARTITION BY p.w ORDER BY pos) AS place
          FROM paired p JOIN best ON best.w = p.w
        )
      )
    )
  )
  WHERE NOT gone
), last AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT state.w, state.id, state.step FROM state JOIN last ON state.w = last.w AND state.step = last.step ORDER BY state.w, state.pos
"""


class Store:
    """Encoded strings: their ids end to end in one array, and if ``named`` the ids of each as text."""

    def __init__(self) -> None:
        self.index: dict[str | bytes, int] = {}
        self.lines: list[str] = []
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.start, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def add(self, keys: list, flat: np.ndarray, sizes: np.ndarray, lines: list[str] | None = None) -> None:
        n = len(self.index)
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.size) < n + len(keys):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[n : n + len(keys)] = sizes
        self.start[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.index.update(zip(keys, range(n, n + len(keys))))
        self.lines.extend(lines or ())

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at ``places`` end to end, and how many each has."""
        sizes = self.size[places]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[places] - (ends - sizes), sizes)
        return self.flat[at], sizes


def reaches(tokens) -> np.ndarray:
    """By three bytes: 1 if a token holds them in a row, 2 if one begins with them; by two bytes (times 65536 more): 4 if they are a token."""
    table = np.zeros(1 << 24, dtype=np.uint8)
    longer = [t for t in tokens if len(t) > 2]
    joined = np.frombuffer(b"".join(longer), dtype=np.uint8).astype(np.int32)
    ends = np.cumsum([len(t) for t in longer])
    whole = np.ones(len(joined), dtype=bool)
    whole[ends - 1] = whole[ends - 2] = False
    at = np.flatnonzero(whole)
    table[joined[at] << 16 | joined[at + 1] << 8 | joined[at + 2]] |= 1
    at = ends - [len(t) for t in longer]
    table[joined[at] << 16 | joined[at + 1] << 8 | joined[at + 2]] |= 2
    for t in tokens:
        if len(t) == 2:
            table[t[0] << 16 | t[1] << 8 : (t[0] << 16 | t[1] << 8) + 256] |= 4
    return table


class Codec:
    """One vocabulary in one DuckDB connection, which keeps to memory and one thread."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.tokens[bytes([i])] for i in range(256)], dtype=np.int32)
        self.known, self.older = Store(), Store()
        self.pieces, self.older_pieces = Store(), Store()
        self.spelled = {i: t for t, i in self.tokens.items()}
        self.sizes = np.zeros(max(self.spelled) + 1, dtype=np.int64)
        self.sizes[list(self.spelled)] = [len(t) for t in self.spelled.values()]
        self.seams: dict[tuple[int, int], bool] = {}
        self.reach = reaches(self.tokens)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        merged = [
            (self.tokens[t[:i]], self.tokens[t[i:]], rank) for t, rank in self.tokens.items() for i in range(1, len(t)) if t[:i] in self.tokens and t[i:] in self.tokens
        ]
        l, r, m = (np.array(x, dtype=np.int64) for x in zip(*merged))
        alone = np.zeros(int(m.max()) + 1, dtype=bool)
        alone[l[m < l]] = alone[r[m < r]] = True
        vocabulary = sorted((i, t.hex()) for t, i in self.tokens.items())
        self.names = pa.array([str(i) for i in range(vocabulary[-1][0] + 1)])
        self._table("merges", l=l, r=r, merged=m, alone=alone[m])
        self._table("vocabulary", id=np.array([i for i, _ in vocabulary], dtype=np.int32), hex=[h for _, h in vocabulary])

    def _table(self, name: str, **columns) -> None:
        rows = pa.table(columns)  # noqa: F841
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows")

    def _short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has: its leftmost pair of least rank is contracted again and again."""
        offsets = np.cumsum([0, *map(len, words)], dtype=np.int32)
        ids = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)].astype(np.int64)
        self._table("tokens", w=np.arange(len(words)), ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))
        got = self.db.sql(f"SELECT * FROM ({_CONTRACT_LEFTMOST}) ORDER BY w").to_arrow_table().combine_chunks()["ids"].combine_chunks()
        return got.flatten().to_numpy(), got.value_lengths().to_numpy()

    def _each(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each part; equal parts are contracted once."""
        distinct = list(dict.fromkeys(parts))
        got: dict[bytes, np.ndarray] = {}
        for i in range(0, len(distinct), 20_000):
            some = distinct[i : i + 20_000]
            flat, sizes = self._short(some)
            got |= zip(some, np.split(flat, np.cumsum(sizes)[:-1]))
        return [got[x] for x in parts]

    def _holding(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether neighbouring tokens of two parts stay as they are when the parts are put together."""
        pairs = list(zip(left.tolist(), right.tolist()))
        if len(self.seams) > REMEMBERED:
            self.seams = {}
        new = [p for p in dict.fromkeys(pairs) if p not in self.seams]
        if new:
            got = self._each([self.spelled[a] + self.spelled[b] for a, b in new])
            self.seams.update((p, tuple(x.tolist()) == p) for p, x in zip(new, got))
        return np.fromiter((self.seams[p] for p in pairs), dtype=bool, count=len(pairs))

    def _long(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: sewn from parts of equal length, else from parts that end with a token, else place by place."""
        done: dict[int, np.ndarray] = {}
        for method in (self._cut_evenly, self._cut_by_tokens):
            left = [w for w in range(len(words)) if w not in done]
            if left:
                done |= {left[k]: x for k, x in self._sewn([method(words[w]) for w in left]).items()}
        left = [w for w in range(len(words)) if w not in done]
        done |= zip(left, self._by_places([words[w] for w in left]) if left else ())
        return [done[w] for w in range(len(words))]

    def _cut_evenly(self, word: bytes) -> list[bytes]:
        return [word[i : i + LONG] for i in range(0, len(word), LONG)]

    def _cut_by_tokens(self, word: bytes) -> list[bytes]:
        """Parts that begin where a token of what stands before ends: in a run of one letter they keep its step."""
        known: dict[bytes, int] = {}
        out, at = [], 0
        while at < len(word):
            ahead = word[at : at + 4 * LONG]
            if ahead not in known:
                ends = np.cumsum(self.sizes[self._each([ahead])[0]])
                known[ahead] = len(ahead) if len(ahead) < 4 * LONG else int(ends[max(0, np.searchsorted(ends, 2 * LONG, side="right") - 1)])
            out.append(word[at : at + known[ahead]])
            at += known[ahead]
        return out

    def _sewn(self, words: list[list[bytes]]) -> dict[int, np.ndarray]:
        """Ids of the words, given in parts, by their number; those of which most seams keep failing are left out."""
        parts = [(w, x) for w, own in enumerate(words) for x in own]
        got = self._each([x for _, x in parts])
        sizes = np.array([len(x) for x in got])
        ids, of = np.concatenate(got), np.repeat([w for w, _ in parts], sizes)
        seam = np.zeros(len(ids), dtype=bool)
        seam[np.cumsum(sizes)[:-1] - 1] = True
        seam[:-1] &= of[:-1] == of[1:]
        most, rounds = None, 0
        while True:
            at = np.flatnonzero(seam)
            holds = self._holding(ids[at], ids[at + 1])
            seam[at[holds]] = False
            at = at[~holds]
            most = len(at) if most is None else most
            if not len(at) or (rounds >= PATIENCE and len(at) > most / 2) or rounds > 8 * PATIENCE:
                break
            wide = min(FAR, NEAR + 2 * rounds)
            first, after = np.searchsorted(of, of[at]), np.searchsorted(of, of[at], side="right")
            regions, upto = [], 0
            # At most 2 * LONG bytes at each side, or one token.
            ends = np.cumsum(self.sizes[ids])
            near = np.minimum(np.searchsorted(ends, ends[at] - 2 * LONG) + 1, at), np.maximum(np.searchsorted(ends, ends[at] + 2 * LONG, side="right"), at + 2)
            for a, b in zip(np.maximum(np.maximum(first, at - wide + 1), near[0]).tolist(), np.minimum(np.minimum(after, at + wide + 1), near[1]).tolist()):
                if a >= upto:
                    regions.append((a, b))
                    upto = b
            fresh = self._each([b"".join(map(self.spelled.__getitem__, ids[a:b].tolist())) for a, b in regions])
            new_ids, new_of, new_seam, upto = [], [], [], 0
            for (a, b), x in zip(regions, fresh):
                before = seam[upto:a].copy()
                if a > upto:
                    before[-1] = of[a - 1] == of[a]
                elif new_seam and a:
                    new_seam[-1][-1] = of[a - 1] == of[a]
                inside = np.zeros(len(x), dtype=bool)
                inside[-1] = b < len(of) and of[b] == of[b - 1]
                new_ids += [ids[upto:a], x]
                new_of += [of[upto:a], np.full(len(x), of[a])]
                new_seam += [before, inside]
                upto = b
            ids, of, seam = (np.concatenate([*new, old[upto:]]) for new, old in ((new_ids, ids), (new_of, of), (new_seam, seam)))
            rounds += 1
        bounds = np.searchsorted(of, np.arange(len(words) + 1))
        done = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        failed = set(of[at].tolist())
        return {w: x for w, x in enumerate(done) if w not in failed}

    def _by_places(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; the places of a word's pair of least rank are contracted together where that is the same."""
        now = {w: self.single[np.frombuffer(x, dtype=np.uint8)].astype(np.int64) for w, x in enumerate(words)}
        done: dict[int, np.ndarray] = {}
        while now:
            sizes = [len(x) for x in now.values()]
            steps = max(1, min(STEPS, ROWS // sum(sizes)))
            self._table("tokens", w=np.repeat(list(now), sizes), pos=np.concatenate([np.arange(n) for n in sizes]), id=np.concatenate(list(now.values())))
            got = self.db.execute(_CONTRACT_ALL_PLACES.format(steps=steps)).fetchnumpy()
            w, ids, step = (np.asarray(got[x]) for x in ("w", "id", "step"))
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            parts = {int(w[a]): (ids[a:b], step[a]) for a, b in zip(starts, [*starts[1:], len(w)])}
            done |= {k: x for k, (x, last) in parts.items() if last < steps}
            now = {k: x for k, (x, last) in parts.items() if last >= steps}
        return [done[w] for w in range(len(words))]

    def cuts(self, joined: np.ndarray) -> np.ndarray:
        """For each byte but the last, whether no token can hold it and the next."""
        none = np.zeros(2, dtype=np.int32)
        code = np.concatenate([joined, none]).astype(np.int32)
        found = self.reach[code[:-2] << 16 | code[1:-1] << 8 | code[2:]]
        # A token over the place between i and i + 1 holds i - 1 too, or begins at i: it is those two bytes or longer.
        across = found[:-1] & 4 > 0
        across[:-1] |= found[:-2] & 2 > 0
        across[1:] |= found[:-2] & 1 > 0
        return ~across

    def _learn_pieces(self, pieces: set[bytes]) -> None:
        if len(self.pieces.index) > REMEMBERED:
            self.older_pieces, self.pieces = self.pieces, Store()
        older = self.older_pieces.index
        new = pieces.difference(self.pieces.index)
        again = [x for x in new if x in older]
        if again:
            self.pieces.add(again, *self.older_pieces.take(np.array([older[x] for x in again])))
            new.difference_update(again)
        short = [x for x in new if len(x) <= LONG]
        for i in range(0, len(short), 20_000):
            self.pieces.add(short[i : i + 20_000], *self._short(short[i : i + 20_000]))
        long = [x for x in new if len(x) > LONG]
        group = np.cumsum([len(x) for x in long]) // TOGETHER
        for k in np.unique(group):
            part = [long[i] for i in np.flatnonzero(group == k)]
            got = self._long(part)
            self.pieces.add(part, np.concatenate(got), np.array([len(g) for g in got]))

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet; of two generations of known words, the older is forgotten when the younger is full."""
        if len(self.known.lines) > REMEMBERED:
            self.older, self.known = self.known, Store()
        older = self.older.index
        new = words.difference(self.known.index)
        again = [x for x in new if x in older]
        if again:
            places = np.array([older[x] for x in again])
            self.known.add(again, *self.older.take(places), [self.older.lines[i] for i in places])
            new.difference_update(again)
        fresh = list(new)
        for i in range(0, len(fresh), 20_000):
            self._learn_words(fresh[i : i + 20_000])

    def _learn_words(self, words: list[str]) -> None:
        raw = [x.encode() for x in words]
        joined = b"".join(raw)
        ends = np.cumsum([len(x) for x in raw])
        last = self.cuts(np.frombuffer(joined, dtype=np.uint8))
        last = np.append(last, True)
        last[ends - 1] = True
        stops = np.flatnonzero(last) + 1
        pieces = [joined[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]
        self._learn_pieces(set(pieces))
        flat, sizes = self.pieces.take(np.fromiter(map(self.pieces.index.__getitem__, pieces), dtype=np.int64, count=len(pieces)))
        total = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.searchsorted(stops, ends, side="right")])]
        self.known.add(words, flat, np.diff(total), self._lines(flat, np.diff(total)))

    def _lines(self, flat: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The ids of each word as text."""
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.names.take(pa.array(flat))), " ").to_pylist()

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts end to end, how many each has, and each text's ids as text; new words are learned in one go."""
        split = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*split))
        index, lines = self.known.index.__getitem__, self.known.lines.__getitem__
        places = [np.fromiter(map(index, x), dtype=np.int64, count=len(x)) for x in split]
        flat, sizes = self.known.take(np.concatenate([np.zeros(0, dtype=np.int64), *places]))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, places)])]
        return flat, np.diff(ends), [" ".join(map(lines, p.tolist())) for p in places]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        flat, sizes, _ = self.encode_flat(texts)
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []

    def decode_flat(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        out = [b""] * len(sizes)
        ends = np.cumsum(sizes)
        first = found = 0
        while first < len(sizes):
            begin = int(ends[first] - sizes[first])
            stop = max(first + 1, int(np.searchsorted(ends, begin + DECODED_AT_ONCE, side="right")))
            part = flat[begin : int(ends[stop - 1])]
            # The view of the rows in DuckDB; an id that the vocabulary lacks makes its run come out short.
            rows = pa.table({"k": np.repeat(np.arange(first, stop, dtype=np.int32), sizes[first:stop]), "pos": np.arange(len(part), dtype=np.int32), "id": part.astype(np.int32)})  # noqa: F841
            for k, hexed, n in self.db.execute("SELECT k, string_agg(hex, '' ORDER BY pos), count(*) FROM rows JOIN vocabulary USING (id) GROUP BY k").fetchall():
                out[k] = bytes.fromhex(hexed)
                found += n
            first = stop
        if found != len(flat):
            raise ValueError("an id is not in the vocabulary")
        return out

    def decode(self, many: list) -> list[bytes]:
        """The bytes of each list of ids."""
        arrays = [np.asarray(x, dtype=np.int64) for x in many]
        return self.decode_flat(np.concatenate([np.zeros(0, dtype=np.int64), *arrays]), np.array([len(x) for x in arrays], dtype=np.int64))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """This process's codec for a rank file; by default that of the installed tokenizer files."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _pieces(texts: list[str], size: int = 1_000_000) -> Iterator[list[str]]:
    """Neighbouring texts, about ``size`` characters together."""
    held: list[str] = []
    n = 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with token_ids, array<int>."""

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for batch in batches:
            for part in _pieces([t or "" for t in batch]):
                yield pd.Series(own.encode(part), dtype=object)

    return docs.withColumn("token_ids", F.pandas_udf(encoded, "array<int>").asNondeterministic()(F.col(text)))


def decode(encoded: DataFrame, ids: str = "token_ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with decoded, the bytes of the ids; null ids are none."""

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for batch in batches:
            yield pd.Series(own.decode([() if x is None else x for x in batch]), dtype=object)

    return encoded.withColumn("decoded", F.pandas_udf(decoded, "binary").asNondeterministic()(F.col(ids)))


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 (and token_ids): encoded, then decoded from the ids, in one pass."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * ids
    kinds = ["long", "string", "string"] + ["array<int>"] * ids

    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for batch in batches:
            # The pieces of a batch go back one by one: only the rows have to add up.
            for part in _pieces([t or "" for t in batch]):
                rows: list[tuple] = []
                flat, sizes, lines = own.encode_flat(part)
                raw, many = own.decode_flat(flat, sizes), np.split(flat, np.cumsum(sizes)[:-1]) if ids else []
                for k, line in enumerate(lines):
                    rows.append((int(sizes[k]), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(raw[k]).hexdigest(), *many[k : k + 1]))
                yield pd.DataFrame(rows, columns=names)

    kept = [c for c in docs.columns if c.lower() not in (*names, "_trip")]
    udf = F.pandas_udf(digests, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).asNondeterministic()
    return docs.select(*(F.col(f"`{c}`") for c in kept), udf(text).alias("_trip")).select(
        *(F.col(f"`{c}`") for c in kept), *(F.col(f"_trip.{n}").alias(n) for n in names)
    )
