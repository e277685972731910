"""Byte-pair encoding and decoding with a published vocabulary.

A word's symbols form a doubly linked list; a priority queue holds the ranks of adjacent pairs. The
lowest rank is popped, checked against the list (stale entries are skipped) and merged, and the two new
neighbours are queued. Texts are cut where no merge can cross, and encodings of short cuts are kept in a
bounded cache, so a corpus costs one merge run for most of its distinct words and a lookup for the rest.
"""

from __future__ import annotations

import array
import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Entries of a worker's cache, and the longest cut kept in it.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 48
#: The splitting patterns of the two vocabularies.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only are in composed form, and lower-casing and splitting treat each alone.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
#: A space and what follows it up to the next white space, or a run of white space as BYTE_SPLIT takes it.
BYTE_CUTS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Commas and points beside other symbols.
TOUCHING = re.compile(r"(?:[^\w\s]|_)[,.]|[,.](?:[^\w\s]|_)")
#: The first blank of a run.
BORDER = re.compile(r"(?<=\S)\s")
#: The rank of a pair that no merge joins.
FREE = np.iinfo(np.int32).max
#: Characters encoded together by Library.
BATCH_CHARS = 4_000_000


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next letter from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


#: Bytes of PLAIN characters but those that 0xC2 begins.
_PLAIN_BYTES = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)])


def plain(text: str) -> bool:
    """Whether all characters are PLAIN; most texts are told so from their bytes."""
    return not text.encode("utf-8", "surrogatepass").translate(None, _PLAIN_BYTES) or not PLAIN.search(text)


#: Bytes of letters, digits, blanks, commas and points: what plain prose is made of.
_PROSE_BYTES = bytes([9, 10, 13, 32, 44, 46, *range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)])


def touching(text: str) -> bool:
    """Whether a comma or point stands beside another symbol."""
    if text.encode("utf-8").translate(None, _PROSE_BYTES) or "×" in text or "÷" in text:
        return bool(TOUCHING.search(text))
    return ",," in text or ".." in text or ",." in text or ".," in text


def blank_run(text: str) -> bool:
    """Whether a plain text without two spaces in a row has other blanks in a row."""
    lone = [b for b in "\t\n\r" if b in text]
    return any(a + b in text or b + a in text for a in lone for b in (" ", *lone))


class Cuts(dict):
    """A bounded cache of what `encode` gives for a cut of text, as little-endian unsigned 32-bit ids."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, cut: str) -> bytes:
        ids = self.old.get(cut)
        if ids is None:
            ids = self.encode(cut)
        if len(cut) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES // 2:
                self.old = dict(self)
                self.clear()
            self[cut] = ids
        return ids


def packed(ids) -> bytes:
    return array.array("I", ids).tobytes()


class Pieces:
    """A vocabulary file's own encoder: merges by priority queue over a linked list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words = spec["normalizer"] is not None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[self.vocab[left] << 32 | self.vocab[right]] = (rank, self.vocab[left + right])
        self.letters = byte_letters()
        self.split = regex.compile(WORD_SPLIT if self.words else BYTE_SPLIT)
        self.cuts, self.firsts = Cuts(self.cut_ids), Cuts(lambda cut: packed(self.chunk(cut)))

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to one word's symbols, lowest rank first, leftmost among equals."""
        n, pairs = len(symbols), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [found[0] << 32 | i for i in range(n - 1) if (found := pairs.get(symbols[i] << 32 | symbols[i + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if left < 0 or j >= n:
                continue
            found = pairs.get(left << 32 | symbols[j])
            if found is None or found[0] != rank:
                continue
            symbols[i] = merged = found[1]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if near := pairs.get(merged << 32 | symbols[k]):
                    heapq.heappush(queue, near[0] << 32 | i)
            h = before[i]
            if h >= 0 and (near := pairs.get(symbols[h] << 32 | merged)):
                heapq.heappush(queue, near[0] << 32 | h)
        return [s for s in symbols if s >= 0]

    def chunk(self, text: str) -> list[int]:
        """Ids of normalised text without special tokens."""
        out: list[int] = []
        for word in self.split.findall(text):
            letters = [self.letters[b] for b in word.encode("utf-8")]
            letters[-1] += self.suffix
            symbols = [self.vocab[x] for x in letters if x in self.vocab]
            out += self.merge(symbols) if len(symbols) > 1 else symbols
        return out

    def cut_ids(self, cut: str) -> bytes:
        return packed(self.chunk(cut if self.words else " " + cut))

    def normal(self, text: str) -> str:
        """Composed form, runs of white space as a space, each character's lower case by itself."""
        if not self.words:
            return text
        return "".join(map(str.lower, regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))))

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        if "<|" in text and self.marks.search(text):
            parts = [packed([self.special[p]]) if p in self.special else packed(self.chunk(self.normal(p))) for p in self.marks.split(text)
                if p]
            return b"".join(parts)
        return by_cuts(self, text, lambda: packed(self.chunk(self.normal(text))))

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings put together, as a file without decoder asks for: a space between tokens."""
        return " ".join(map(self.strings.__getitem__, ids))


def by_cuts(coder, text: str, whole) -> bytes:
    """Ids of a text without special tokens, put together from cached cuts where cutting is safe, else whole()."""
    if coder.words:
        if text.isascii() and not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text) or not PLAIN.search(text):
            return b"".join(map(coder.cuts.__getitem__, text.lower().split()))
        return whole()
    if "  " in text:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return whole()
        return b"".join([coder.cuts[c[1:]] if c[0] == " " and not c.isspace() else coder.firsts[c] for c in BYTE_CUTS.findall(text)])
    first, *rest = text.split(" ")
    return (coder.firsts[first] if first else b"") + b"".join(map(coder.cuts.__getitem__, rest))


class Library:
    """Ids as the tokenizers library gives them, at the speed a whole corpus needs.

    Ordinary texts are cut, and a batch's cuts that no cache holds are merged together in numpy, with ids
    equal to the library's; texts with special marks or characters outside PLAIN go to the library itself.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES, chars: int | None = None):
        """entries: cuts to keep; chars: characters encoded together, which takes about nine bytes each."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pieces = Pieces(path)
        self.words, self.split, self.known = pieces.words, pieces.split, Recurring(entries)
        self.merges, self.chars = MergeTable(pieces), chars or BATCH_CHARS

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def cut(self, text: str) -> str | None:
        """The text with its cuts, which may be encoded apart, told by zeros (or by blanks, where those part words), or None
        if the text is not an ordinary one.

        Commas and points that no other symbol touches are cut off their words, so that fewer cuts differ. What touches
        is looked for in lower case, where a letter may have become a letter and a mark; a space before a comma or point
        is part of the same word of BYTE_SPLIT.
        """
        if "<|" in text or not plain(text):
            return None
        if self.words:
            text = text.lower()
            return text if touching(text) else text.replace(",", " , ").replace(".", " . ")
        if "  " in text:
            return "\0".join(BYTE_CUTS.findall(text))
        if " ," not in text and " ." not in text and not touching(text) and not blank_run(text):
            text = text.replace("\n", "\0\n\0").replace(",", "\0,").replace(".", "\0.")
        return text.replace(" ", "\0 ")

    def learn(self, cuts: pa.StringArray) -> pa.ListArray:
        """The ids of distinct cuts, all their words merged at once; long cuts go to the library."""
        long = np.asarray(pc.utf8_length(cuts)) > CACHE_CHARS
        bare = cuts if self.words else pc.if_else(pc.starts_with(cuts, " "), pc.utf8_slice_codeunits(cuts, 1), cuts)
        letters = np.asarray(pc.utf8_is_alpha(bare)) & ~long
        others = ~letters & ~long
        found = [self.split.findall(cut) for cut in cuts.filter(pa.array(others)).to_pylist()]
        words = pa.concat_arrays([cuts.filter(pa.array(letters)), pa.array(itertools.chain.from_iterable(found), pa.string())])
        words = words.dictionary_encode()
        lists = self.merges.many(words.dictionary).take(words.indices)
        whole = [np.frombuffer(self.whole(cut), "<u4") for cut in cuts.filter(pa.array(long)).to_pylist()]
        # Words of each cut: those of letters only come first, then all others, long ones last.
        counts = np.concatenate([np.ones(letters.sum(), np.int64), np.fromiter(map(len, found), np.int64, len(found))])
        ends = np.asarray(lists.offsets)[borders(counts)]
        ends = np.concatenate([ends, ends[-1] + np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))])
        ids = np.concatenate([np.asarray(lists.flatten()), *whole]).astype(np.uint32, copy=False)
        place = np.empty(len(cuts), np.int64)
        place[np.concatenate([np.flatnonzero(letters), np.flatnonzero(others), np.flatnonzero(long)])] = np.arange(len(cuts))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)).take(pa.array(place))

    def ids_of(self, texts: list[str], stretch: bool = True) -> list[bytes]:
        """Ids of whole texts, a few at a time so that the cuts of few are in memory; very long ones in stretches."""
        out, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) < self.chars):
                chars += len(texts[end])
                end += 1
            if stretch and chars > 4 * self.chars and (parts := stretches(texts[at])):
                out.append(b"".join(x for part in parts for x in self.ids_of([part], False)))
            else:
                cuts = [self.cut(t) for t in texts[at:end]]
                found = iter(self.of_cuts([c for c in cuts if c is not None]))
                out += [self.whole(t) if c is None else next(found) for c, t in zip(cuts, texts[at:end], strict=True)]
            at = end
        return out

    def of_cuts(self, cuts: list[str]) -> list[bytes]:
        """The ids of texts told in cuts: distinct cuts are looked up once, and Arrow puts the ids of all of them in order."""
        if not cuts:
            return []
        marked = pa.array(cuts, pa.string())
        lists = pc.ascii_split_whitespace(marked) if self.words else pc.split_pattern(marked, "\0")
        numbers, table = self.known.look(lists.flatten(), self.learn)
        raw = np.asarray(table.take(numbers).flatten()).astype("<u4", copy=False).tobytes()
        sizes = np.diff(np.asarray(table.offsets))[np.asarray(numbers)]
        places = borders(sizes)[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
        return [raw[4 * a : 4 * b] for a, b in itertools.pairwise(places)]


def borders(sizes: np.ndarray) -> np.ndarray:
    """Where runs of so many things begin, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(sizes)])


def stretches(text: str) -> list[str]:
    """A very long ordinary text in stretches that may be encoded apart; put together they are the text.

    Both splitting patterns end a word at white space and look ahead only, so any border before a run of white
    space is safe. Without such a border the rest is one stretch.
    """
    if "<|" in text or not plain(text):
        return []
    out, at = [], 0
    while at < len(text):
        border = BORDER.search(text, at + BATCH_CHARS)
        end = border.start() if border else len(text)
        out.append(text[at:end])
        at = end
    return out


class Recurring:
    """A bounded cache of cuts and their ids in Arrow arrays, a tenth of the size of Python's strings: once there are more
    than `entries`, the half that was used most stays, and its uses count half."""

    def __init__(self, entries: int):
        self.entries, self.uses = entries, np.zeros(0, np.int64)
        self.young, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))

    def look(self, cuts: pa.StringArray, learn) -> tuple[pa.Array, pa.ListArray]:
        """For each cut a number, and the ids by number; `learn` gives those of cuts that are not here."""
        n = len(self.young)
        numbered = pa.concat_arrays([self.young, cuts]).dictionary_encode()
        names, numbers, ids = numbered.dictionary, numbered.indices.slice(n), self.ids
        if len(names) > n:
            ids = pa.concat_arrays([ids, learn(names.slice(n))])
        uses = np.bincount(np.asarray(numbers), minlength=len(names))
        uses[:n] += self.uses
        self.keep(names, ids, uses, n)
        return numbers, ids

    def keep(self, names: pa.StringArray, ids: pa.ListArray, uses: np.ndarray, n: int) -> None:
        """Keep these but for the long ones, of which the first n hold none."""
        stay = n + np.flatnonzero(np.asarray(pc.utf8_length(names.slice(n))) <= CACHE_CHARS)
        stay = np.concatenate([np.arange(n), stay])
        if len(stay) > self.entries:
            stay = np.sort(stay[np.argpartition(-uses[stay], self.entries // 2)[: self.entries // 2]])
            uses = uses // 2
        if len(stay) < len(names):
            names, ids, uses = names.take(pa.array(stay)), ids.take(pa.array(stay)), uses[stay]
        self.young, self.ids, self.uses = names, ids, uses


class MergeTable:
    """The merges of many words at once: each round merges every word's lowest pair, leftmost among equals."""

    def __init__(self, pieces: Pieces):
        vocab, letters = pieces.vocab, pieces.letters
        self.start = np.array([vocab.get(x, -1) for x in letters], np.int64)
        self.end = np.array([vocab.get(x + pieces.suffix, -1) for x in letters], np.int64)
        assert min(self.start.min(), self.end.min()) >= 0, "a vocabulary of all bytes is asked for"
        keys = np.fromiter(pieces.pairs, np.int64)
        self.rank = np.array([r for r, _ in pieces.pairs.values()], np.int32)
        self.merged = np.empty(int(self.rank.max()) + 1, np.int64)
        self.merged[self.rank] = [m for _, m in pieces.pairs.values()]
        self.bits = max(16, int(len(keys)).bit_length() + 4)
        slots, left, self.probes = self.slot(keys), np.arange(len(keys)), 0
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, FREE, np.int32)
        while len(left):
            at = slots[left] + self.probes & (1 << self.bits) - 1
            empty = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            taken = np.zeros(len(left), bool)
            taken[first] = True
            taken &= empty
            self.keys[at[taken]], self.ranks[at[taken]] = keys[left[taken]], self.rank[left[taken]]
            left, self.probes = left[~taken], self.probes + 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot, out = self.slot(key), np.full(key.shape, FREE, np.int32)
        for d in range(self.probes):
            at = slot + d & (1 << self.bits) - 1
            hit = self.keys[at] == key
            out[hit] = self.ranks[at[hit]]
            if d == 0 and hit.all():
                break
        return out

    def many(self, words: pa.StringArray) -> pa.ListArray:
        """The ids of each word; none is empty."""
        if not len(words):
            return pa.array([], pa.list_(pa.uint32()))
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        letters, lengths, done = np.frombuffer(words.buffers()[2], np.uint8), np.diff(at), []
        by_length = np.argsort(lengths, kind="stable")
        for rows in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1):
            raw = letters[at[rows][:, None] + np.arange(lengths[rows[0]])]
            done += self.merge(rows, raw)
        sizes = np.empty(len(words), np.int64)
        for rows, symbols in done:
            sizes[rows] = symbols.shape[1]
        ends = borders(sizes)
        ids = np.empty(ends[-1], np.uint32)
        for rows, symbols in done:
            ids[ends[rows][:, None] + np.arange(symbols.shape[1])] = symbols
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

    def merge(self, rows: np.ndarray, raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of words of one length, given as a row of bytes each: parts of `rows` with as many ids for each of its words."""
        done, symbols = [], self.start[raw]
        symbols[:, -1] = self.end[raw[:, -1]]
        ranks = self.find(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1:
            at = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), at]
            if (over := low == FREE).any():
                done.append((rows[over], symbols[over]))
                go = ~over
                symbols, ranks, rows, at, low = symbols[go], ranks[go], rows[go], at[go], low[go]
                if not len(rows):
                    return done
            width, here = symbols.shape[1] - 1, np.arange(len(rows))
            col = np.arange(width)[None, :]
            symbols = np.take_along_axis(symbols, col + (col > at[:, None]), 1)
            symbols[here, at] = self.merged[low]
            col = np.arange(width - 1)[None, :]
            ranks = np.take_along_axis(ranks, col + (col >= at[:, None]), 1)
            has = at > 0
            ranks[here[has], at[has] - 1] = self.find(symbols[here[has], at[has] - 1], symbols[here[has], at[has]])
            has = at < width - 1
            ranks[here[has], at[has]] = self.find(symbols[here[has], at[has]], symbols[here[has], at[has] + 1])
        return [*done, (rows, symbols)]


_coders: dict = {}


def coder(kind, path: str, **options):
    """This worker's encoder for a vocabulary file."""
    if (kind, path) not in _coders:
        _coders[kind, path] = kind(path, **options)
    return _coders[kind, path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>, decoded string) of every row.

    Null and empty texts have no ids and decode to an empty string. Repeated rows give repeated results;
    null ids and other columns do no harm.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = coder(Pieces, path)
        ids = [array.array("I", pieces.ids(t or "")).tolist() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32())),
            pa.array(list(map(pieces.decode, ids)), pa.string())], ["id", "token_ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "id long, token_ids array<int>, decoded string", rows=128)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract 4 over all documents."""
    coded = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
