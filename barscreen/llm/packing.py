"""Hierarchical packing of documents into sequences of several lengths.

A document is encoded where it is read. Its full windows of the longest tier become sequences by themselves; what
remains is routed to the shortest tier that holds it. Each tier packs what it gets, in order, into windows of its
length, cutting a document at the end of a window. When a partition ends, the open window of the longest tier takes
what the shorter tiers still hold, and the last rest is cut into windows of shorter tiers, which it fills; less than
the shortest tier is padded. A partition thus pads one sequence at most, and no id is shuffled.

Sequences go to step groups. A full group holds the same number of tokens in every tier, windows of that tier alone.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches

#: Lengths of sequences, powers of two.
TIERS = (128, 256, 512, 1024, 2048)
#: Tokens of a full step group.
GROUP_TOKENS = 1 << 16
#: Words whose ids a worker remembers; then it starts afresh.
REMEMBERED = 1 << 20
#: A name in the table of modules of a worker, under which it keeps words.
KEPT = "_words_of_packing"
#: Texts, and words, that are encoded together.
TEXTS = 256
LEARNT = 4096
END_ID = 1
#: What tokens that end a word end with.
WORD_END = "</w>"
#: Units of ASCII words in lower case, which the tokenizer encodes each by itself.
UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file, where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Ids of a piece of text between white space, as bytes.

    The tokenizer drops white space, folds case and never joins what white space parts: a text's ids are those of
    its lower-cased pieces in order. A full stop or comma after a letter or digit is a token of its own. Names of
    special tokens are searched before all that, so a text that has one, in any case, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # for lower-case ASCII letters, which nothing but the model changes
        self.names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith(WORD_END)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        if piece[-1:] in (b".", b",") and piece[-2:-1].isalnum():
            ids = self[piece[:-1]] + self[piece[-1:]]
        else:
            ids = self.whole(piece.decode())
        self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Words that aren't known yet are encoded together."""
        if len(self) > REMEMBERED:
            self.clear()
        split = []
        for text in texts:
            low = text.encode().lower()
            split.append(None if any(name in text or name.encode().lower() in low for name in self.names) else low.split())
        self.learn(set().union(*filter(None, split)) - self.keys())
        return [self.whole(text) if found is None else b"".join(map(self.__getitem__, found)) for text, found in zip(texts, split)]

    def learn(self, pieces: set[bytes]) -> None:
        """The ids of words, many at a time. Of each unit of a word the last id, and no other, ends a unit, so units are counted.

        Words of letters only are one unit, or more where a letter is changed into more than letters; ASCII words have
        as many as the pattern finds. So if all units of some words are as many as expected, those of each word are.
        """
        bare = {p[:-1] if p[-1:] in (b".", b",") and p[-2:-1].isalnum() else p for p in pieces} - self.keys()
        plain, words, units = [], [], []
        for piece in sorted(bare):
            word = piece.decode()
            if piece.isalpha():
                plain.append(word)
            elif word.isalpha():
                words.append(word)
                units.append(1)
            elif piece.isascii():
                words.append(word)
                units.append(len(UNIT.findall(word)))
        for at in range(0, len(plain), LEARNT):
            some = plain[at : at + LEARNT]
            [found] = self.bare.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)
            self._learnt(some, np.arange(1, len(some) + 1), found.ids)
        for at in range(0, len(words), LEARNT):
            some = words[at : at + LEARNT]
            [found] = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            self._learnt(some, np.cumsum(units[at : at + LEARNT]), found.ids)

    def _learnt(self, words: list[str], units: np.ndarray, ids: list[int]) -> None:
        """Take the ids of words, of which so many units end up to the end of each; none if there are more."""
        found = np.array(ids, "<u4")
        last = np.flatnonzero(self.ends[found]) + 1
        if len(last) == units[-1] and last[-1] == len(found):
            raw, last = found.tobytes(), last[units - 1].tolist()
            self.update((w.encode(), raw[4 * a : 4 * b]) for w, a, b in zip(words, [0, *last], last))


def worker_words(path: str) -> WordIds:
    """The words of one vocabulary, which a Python worker keeps from one task to the next."""
    kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__.setdefault("words", {})
    if path not in kept:
        kept.clear()
        kept[path] = WordIds(path)
    return kept[path]


class Packer:
    """Windows of one partition, as pieces."""

    def __init__(self, tiers: tuple[int, ...], group_tokens: int, first_id: int):
        self.tiers, self.group_tokens, self.first_id = tiers, group_tokens, first_id
        self.queues = {t: deque() for t in tiers}
        self.held = dict.fromkeys(tiers, 0)
        self.sequences, self.numbers = 0, dict.fromkeys(tiers, 0)
        self.pieces: list[tuple] = []

    def add(self, key, ids: bytes) -> None:
        n, top, at = len(ids) // 4, self.tiers[-1], 0
        while n - at >= top:
            self._emit(top, [(key, at, ids[4 * at : 4 * (at + top)], n)])
            at += top
        if at < n:
            tier = next(t for t in self.tiers if t >= n - at)
            self.queues[tier].append((key, at, ids[4 * at :], n))
            self.held[tier] += n - at
            while self.held[tier] >= tier:
                self._emit(tier, self._take(tier, tier))

    def _take(self, tier: int, wanted: int) -> list[tuple]:
        """``wanted`` tokens from the front of a tier's queue; the last piece is cut."""
        queue, out = self.queues[tier], []
        self.held[tier] -= wanted
        while wanted:
            key, start, ids, n = queue.popleft()
            size = len(ids) // 4
            if size > wanted:
                queue.appendleft((key, start + wanted, ids[4 * wanted :], n))
                ids, size = ids[: 4 * wanted], wanted
            out.append((key, start, ids, n))
            wanted -= size
        return out

    def _emit(self, tier: int, parts: list[tuple]) -> None:
        number = self.numbers[tier]
        self.numbers[tier] += 1
        group = number // max(1, self.group_tokens // tier)
        offset = 0
        for key, start, ids, n in parts:
            size = len(ids) // 4
            self.pieces.append((key, start, size, zlib.crc32(ids), n, self.first_id + self.sequences, offset, tier, group))
            offset += size
        self.sequences += 1

    def finish(self) -> None:
        """Fill the open long window from shorter tiers, then cut the rest into tiers that it fills."""
        top = self.tiers[-1]
        for tier in reversed(self.tiers[:-1]):
            self.queues[top].extend(self.queues[tier])
            self.held[top] += self.held[tier]
            self.queues[tier].clear()
            self.held[tier] = 0
        for tier in reversed(self.tiers):
            while self.held[top] >= tier:
                self._emit(tier, self._take(top, tier))
        if self.held[top]:
            self._emit(self.tiers[0], self._take(top, self.held[top]))

    def taken(self) -> list[tuple]:
        out, self.pieces = self.pieces, []
        return out


OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_documents(docs: DataFrame, tokenizer: str, *, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, text): doc_id and the columns of ``OUT``.

    ``tokenizer`` is the path of a vocabulary, the same on all executors. A document's ids are those of its text
    and then id 1, so a null or empty text has one. ``start`` is the place of the piece in its document, ``offset``
    its place in its sequence, ``tier`` the length of the window; a sequence that ends a partition may fill its
    window in part. ``step_group`` counts within the partition (the high bits of ``sequence_id``) and tier.
    Repeated rows are packed each for itself. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    if sorted(set(tiers)) != list(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two that ascend")
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches):
        words = worker_words(tokenizer)
        packer = Packer(tiers, group_tokens, TaskContext.get().partitionId() << 33)
        end = np.array([END_ID], "<u4").tobytes()

        def rows(id_type):
            pieces = packer.taken()
            columns = list(zip(*pieces)) or [()] * 9
            kinds = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", *[x.split()[0] for x in OUT.split(", ")]])

        id_type = pa.int64()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            id_type = ids.type
            for at in range(0, len(texts), TEXTS):
                some = [text or "" for text in texts[at : at + TEXTS].to_pylist()]
                for key, found in zip(ids[at : at + TEXTS].to_pylist(), words.encode(some)):
                    packer.add(key, found + end)
            yield rows(id_type)
        packer.finish()
        yield rows(id_type)

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {OUT}")
