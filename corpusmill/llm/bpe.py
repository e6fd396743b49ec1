"""Byte-level BPE encoding and decoding.

Two styles of one method: the text is cut by the vocabulary's pattern, ranked
merges are folded over the bytes of distinct words, decoding concatenates the
ids' binary pieces.

``encode_documents`` folds in Arrow batches: each worker folds a word once and
keeps its ids in a cache of bounded size. Parts of a word are ids and not bytes:
what two ids merge to is looked up in a table of the vocabulary's pairs. This is the main path, because the
higher-order functions below, though right, take three times the CPU seconds
that they may (figures in the README).

``encode_documents_native`` folds with Spark higher-order functions over a
literal rank map. The text is cut by the vocabulary's pattern. A word's bytes become ids, and a
fold merges, at each step, the neighbouring pair of least rank until none is
left; ranks come from a literal map of id pairs. The map is a perfect hash
(displacement table, keys, values) because Spark searches its own map type
from the front.

Most words of a corpus are few, so a second literal map of bounded size holds
the ids of the ``HEAD`` most frequent words of a bounded sample of documents,
folded once each; any word not in it is folded where it stands. The map only
saves work: results don't depend on it. No document is shuffled.

Decoding gets each id's bytes from a literal array of hex pieces, joins them
and turns them into binary.

Defined results: null and empty texts have no ids, their digests are those of
the empty string; ids not in the vocabulary fail the decoding; rows repeated
are encoded alike; null identifiers and empty tables do not matter; other
columns pass through, but ``ids`` and ``decoded`` are replaced. Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words in the literal word map, and documents sampled to find them.
HEAD, HEAD_DOCUMENTS = 60_000, 6_000
#: White space as the pattern's \s means it, letters and numbers newer than Java 17's tables
#: (Unicode 14 to 16). Fixed values of the Unicode Character Database.
SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NEW_LETTERS = (
    "870-887 889-88E 8B5-8B5 8C8-8C9 C5D-C5D CDD-CDD 170D-170D 171F-171F 1B4C-1B4C 1C89-1C8A 2C2F-2C2F "
    "2C5F-2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3-A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A "
    "1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 "
    "10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 "
    "11075-11075 1123F-11240 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 "
    "113D3-113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02-11F02 11F04-11F10 11F12-11F33 12F90-12FF0 "
    "1342F-1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF-18CFF 1AFF0-1AFF3 "
    "1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132-1B132 1B155-1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D "
    "1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0-1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE "
    "2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF "
)
NEW_NUMBERS = (
    "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 "
    "1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA "
)
#: A rank above all others: no merge.
NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank from a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def java_pattern(pattern: str) -> str:
    r"""The same pattern for Java: \s, \S, \p{L} and \p{N} by explicit classes."""
    letters, numbers = ("".join("\\x{%s}-\\x{%s}" % tuple(x.split("-")) for x in t.split()) for t in (NEW_LETTERS, NEW_NUMBERS))
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}\\p{{L}}\\p{{N}}{letters}{numbers}]")
    out = out.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    return out.replace(r" ?\p{L}+", f" ?[\\p{{L}}{letters}]+").replace(r" ?\p{N}+", f" ?[\\p{{N}}{numbers}]+")


def prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def slots_for(n: int) -> int:
    """A prime, so that every step visits every slot."""
    return prime_from(max(1, n) * 5 // 4 + 7)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket, and the slot of each hash; all slots differ.

    bucket = hash mod the number of buckets; slot = ((hash >>> 32) + d * step)
    mod the number of slots with the step from the hash's low bits.
    """
    h = hashes.astype(np.uint64)
    n = max(1, len(h))
    n_buckets, n_slots = n // 3 + 1, slots_for(n)
    bucket = (h.view(np.int64) % n_buckets).astype(np.int64)
    base = (h >> np.uint64(32)).astype(np.int64)
    step = 1 + ((h >> np.uint64(8)) & np.uint64(0xFFFFF)).astype(np.int64) % (n_slots - 1)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    taken = np.zeros(n_slots, bool)
    moved = np.zeros(n_buckets, np.int64)
    slots = np.zeros(len(h), np.int64)
    for b in np.argsort(-np.diff(edges), kind="stable"):
        inside = order[edges[b] : edges[b + 1]]
        if not len(inside):
            break
        lows, steps = base[inside].tolist(), step[inside].tolist()
        for d in range(1 << 20):
            at = [(x + d * y) % n_slots for x, y in zip(lows, steps)]
            if len(set(at)) == len(at) and not taken[at].any():
                break
        else:
            raise RuntimeError("no perfect hash")
        taken[at] = True
        moved[b] = d
        slots[inside] = at
    return moved, slots


def _slot(h: Column, moved: Column, n_buckets: int, n_slots: int) -> Column:
    d = F.get(moved, F.pmod(h, F.lit(n_buckets).cast("long")).cast("int"))
    step = F.shiftright(h, 8).bitwiseAND(F.lit(0xFFFFF).cast("long")) % (n_slots - 1) + 1
    return F.pmod(F.shiftrightunsigned(h, 32) + d * step, F.lit(n_slots).cast("long")).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of a lambda variable bound to ``value``, which is so evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Vocabulary:
    """Literal tables of a rank file."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.pattern = java_pattern(pattern)
        self.pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece.hex().upper()
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        hashes = np.fromiter((xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42) for k in pairs), np.uint64, len(pairs))
        moved, slots = perfect_hash(hashes)
        self.n_buckets, self.n_slots = len(moved), slots_for(len(pairs))
        key_at, rank_at = np.full(self.n_slots, -1), np.full(self.n_slots, NONE)
        key_at[slots], rank_at[slots] = keys, np.fromiter(pairs.values(), np.int64, len(pairs))
        self.rank_map = json.dumps({"m": moved.tolist(), "k": key_at.tolist(), "r": rank_at.tolist(), "b": self.byte_ids}, separators=(",", ":"))

    def literal_ranks(self) -> Column:
        return F.from_json(F.lit(self.rank_map), "m array<bigint>, k array<bigint>, r array<int>, b array<int>")

    def fold(self, word: Column, t: Column) -> Column:
        """Array of ids of one word; ``t`` is the rank map's struct."""

        def rank(a: Column, b: Column) -> Column:
            key = F.shiftleft(a.cast("long"), 20).bitwiseOR(b.cast("long"))
            at = _let(key, lambda k: _slot(F.xxhash64(k), t["m"], self.n_buckets, self.n_slots))
            return _let(at, lambda s: F.when(F.get(t["k"], s) == key, F.get(t["r"], s)).otherwise(F.lit(NONE)))

        def merged(state: Column, _: Column) -> Column:
            ids, ranks, m = state["ids"], state["ranks"], F.array_min(state["ranks"])

            def at(p: Column) -> Column:
                # p is 1-based: ids p and p + 1 become the id m
                left = F.when(p > 1, F.array(rank(F.get(ids, p - 2), m))).otherwise(F.array().cast("array<int>"))
                right = F.when(p + 1 < F.size(ids), F.array(rank(m, F.get(ids, p + 1)))).otherwise(F.array().cast("array<int>"))
                new_ids = F.concat(F.slice(ids, F.lit(1), p - 1), F.array(m), F.slice(ids, p + 2, F.size(ids)))
                new_ranks = F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(ranks, p + 2, F.size(ids)))
                return F.struct(new_ids.alias("ids"), new_ranks.alias("ranks"))

            return F.when(F.coalesce(m, F.lit(NONE)) >= NONE, state).otherwise(_let(F.array_position(ranks, m).cast("int"), at))

        single = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        ids0 = F.transform(single, lambda c: F.get(t["b"], F.ascii(c)))

        def start(ids: Column) -> Column:
            ranks = F.transform(F.slice(ids, F.lit(1), F.size(ids) - 1), lambda a, i: rank(a, F.get(ids, i + 1)))
            return F.struct(ids.alias("ids"), ranks.alias("ranks"))

        first = _let(ids0, start)
        steps = F.sequence(F.lit(1), F.octet_length(word))
        return F.aggregate(steps, first, merged, lambda s: s["ids"])

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def head_words(self, df: DataFrame, id_col: str, text_col: str, head: int = HEAD, documents: int = HEAD_DOCUMENTS) -> list[tuple[str, str]]:
        """(word, its ids joined by commas) of the most frequent words of a sample of documents."""
        n = df.select(F.count(F.lit(1))).first()[0]
        share = max(1, round(1_000_000 * min(1.0, documents / max(1, n))))
        some = df.where(F.pmod(F.xxhash64(df[id_col].cast("string")), F.lit(1_000_000)) < share)
        counted = some.select(F.explode(self.words(F.coalesce(df[text_col].cast("string"), F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        top = counted.orderBy(F.desc("n"), "w").limit(head).select("w").repartition(24)
        ids = _let(self.literal_ranks(), lambda t: F.array_join(self.fold(F.col("w"), t), ","))
        return sorted((r.w, r.ids) for r in top.select("w", ids.alias("ids")).collect())

    def encoder(self, head: list[tuple[str, str]]):
        """A function from a non-null text column to its ids, joined by commas."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8"), 42) for w, _ in head), np.uint64, len(head))
        moved, slots = perfect_hash(hashes)
        n_slots = slots_for(len(head))
        word_at, ids_at = [None] * n_slots, [None] * n_slots
        for (w, ids), s in zip(head, slots.tolist()):
            word_at[s], ids_at[s] = w, ids
        body = json.dumps({"m": moved.tolist(), "w": word_at, "i": ids_at}, separators=(",", ":"))
        head_map = F.from_json(F.lit(body), "m array<bigint>, w array<string>, i array<string>")

        def encode(text: Column) -> Column:
            def with_tables(t: Column, h: Column) -> Column:
                def of(word: Column) -> Column:
                    at = _slot(F.xxhash64(word), h["m"], len(moved), n_slots)
                    known = _let(at, lambda s: F.when(F.get(h["w"], s) == word, F.get(h["i"], s)))
                    return F.coalesce(known, F.array_join(self.fold(word, t), ","))

                return F.array_join(F.transform(self.words(text), of), ",")

            return _let(self.literal_ranks(), lambda t: _let(head_map, lambda h: with_tables(t, h)))

        return encode

    def decode(self, ids: Column) -> Column:
        """Binary of ids joined by commas."""
        pieces = F.from_json(F.lit(json.dumps(self.pieces, separators=(",", ":"))), "array<string>")

        def one(p: Column, i: Column) -> Column:
            return F.coalesce(F.get(p, i.cast("int")), F.raise_error(F.lit("id not in the vocabulary")))

        listed = F.filter(F.split(ids, ","), lambda x: x != "")
        return F.unhex(_let(pieces, lambda p: F.array_join(F.transform(listed, lambda i: one(p, i)), "")))


#: Words that a worker keeps, in each of two generations, and the longest word that it keeps.
CACHE, CACHED_WORD = 100_000, 64
#: Letters and numbers that the regex module (2026.9.29) knows beyond Unicode 16. Fixed values.
LATER_LETTERS = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 "
    "AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DF1-11DF1 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
LATER_NUMBERS = "11DE0-11DE9 1246F-1246F 12475-1247F 12550-12686 16FF4-16FF6 "


def _class_body(ranges: str) -> str:
    return "".join("\\U%08X-\\U%08X" % tuple(int(x, 16) for x in r.split("-")) for r in ranges.split())


#: Of ids that nothing merges with.
NOTHING: dict[int, int] = {}


class Codec:
    """Encodes and decodes in one Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pieces = {str(rank): piece for piece, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        letters, numbers = _class_body(LATER_LETTERS), _class_body(LATER_NUMBERS)
        self.later = regex.compile(f"[{letters}{numbers}]")
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{letters}{numbers}]]")
        exact = exact.replace(r" ?\p{L}+", f" ?[\\p{{L}}--[{letters}]]+").replace(r" ?\p{N}+", f" ?[\\p{{N}}--[{numbers}]]+")
        self.split_exactly = regex.compile(exact, regex.V1)
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        #: Of each id, the ids that may follow it and what the two merge to, which is its rank too.
        self.after: list[dict[int, int]] = [NOTHING] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    if self.after[a] is NOTHING:
                        self.after[a] = {}
                    self.after[a][b] = rank

    def fold(self, word: bytes) -> tuple[int, ...]:
        """Merges the neighbours of least rank, the first of equals, until no pair has a rank."""
        ranks = self.ranks
        if word in ranks:
            return (ranks[word],)
        if len(word) > CACHED_WORD:
            return self.fold_long(word)
        after = self.after
        ids = [self.byte_ids[b] for b in word]
        pair = [after[a].get(b, NONE) for a, b in zip(ids, ids[1:])]
        while pair:
            least = min(pair)
            if least == NONE:
                break
            i = pair.index(least)
            ids[i] = least
            del ids[i + 1], pair[i]
            if i < len(pair):
                pair[i] = after[least].get(ids[i + 1], NONE)
            if i:
                pair[i - 1] = after[ids[i - 1]].get(least, NONE)
        return tuple(ids)

    def fold_long(self, word: bytes) -> tuple[int, ...]:
        """The same fold with a heap of pairs and links between parts: n log n for words of any length."""
        ranks, n = self.ranks, len(word)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # a part starts at its first byte
        gone = bytearray(n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if gone[i] or j >= n or end[j] != stop:
                continue  # one of the two was merged meanwhile
            end[i], gone[j] = stop, 1
            if stop < n:
                left[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (k := left[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
                heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def miss(self, word: str) -> str:
        """Decimal ids of a word that the young generation may lack."""
        found = self.young.get(word) or self.old.get(word)
        if found is None:
            found = ",".join(map(str, self.fold(word.encode("utf-8"))))
        if len(word) <= CACHED_WORD:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def encode(self, text: str | None) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        known, miss = self.young.get, self.miss
        return ",".join([known(w) or miss(w) for w in self.splitter(text).findall(text)])

    def splitter(self, text: str) -> regex.Pattern:
        """The plain pattern unless the text has a later letter or number, all of which lie beyond Latin-1."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_exactly if self.later.search(text) else self.split
        return self.split

    def decode(self, ids: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (decimal ids joined by commas) and ``decoded`` (binary, from the ids); columns so named are replaced.

    ``path`` is the rank file's place, the same on all machines.
    """

    @F.pandas_udf("struct<ids string, decoded binary>")
    def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker = codec(path, pattern)
        for texts in parts:
            ids = list(map(worker.encode, texts))
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(list(map(worker.decode, ids)), dtype=object)})

    # one worker a task does both: two would double the memory
    common.ready_for_python(df.sparkSession)
    name = common.free_name(df, "bpe")
    return df.withColumn(name, both(df[text_col].cast("string"))).withColumns({k: F.col(f"{name}.{k}") for k in ("ids", "decoded")}).drop(name)


def encode_documents_native(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`encode_documents` gives, by higher-order functions only."""
    encode = vocabulary.encoder(vocabulary.head_words(df, id_col, text_col))
    out = df.withColumn("ids", encode(F.coalesce(df[text_col].cast("string"), F.lit(""))))
    return out.withColumn("decoded", vocabulary.decode(F.col("ids")))


def public_files() -> tuple[str, str]:
    """(rank file, pattern) of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def public_vocabulary() -> Vocabulary:
    return Vocabulary(*public_files())


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents."""
    ids = F.col("ids")
    n = F.when(ids == "", 0).otherwise(F.length(ids) - F.length(F.translate(ids, ",", "")) + 1)
    return df.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_documents(docs, *public_files()))


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
