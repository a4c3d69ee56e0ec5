"""Encoding text with public tokenizers inside Arrow functions.

A vocabulary that drops white space and ends words with a suffix gives the same ids for a text as for
its words one after another. For such a vocabulary the words of an Arrow batch are dictionary-encoded
by Arrow, only words not met before are encoded by the library, many of them in one call, and the ids of
texts are gathered with numpy. Where the vocabulary lowers letters and cuts between a letter and a stop, so do
we beforehand, which leaves fewer different words. A worker keeps at most `MEMO_WORDS`, and of those the ones met
in most batches. Other vocabularies encode whole texts in batches of `BATCH_BYTES`.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfline.llm.arrays import raw_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMO_WORDS = 500_000
BATCH_BYTES = 4 << 20
JOINED_WORDS = 256
#: Normalizer steps that treat each word on its own.
WORDWISE = {"NFC", "Lowercase", "Replace"}
# Fixed value: how a vocabulary cuts words whose letters, digits and other signs are words of their own.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What starts a special token; texts that hold it are left as they are.
SPECIAL = b"<|"
STOPS = b".,;:!?"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.isin(np.arange(256), np.frombuffer(STOPS, np.uint8))
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[97:123] = True


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut positions `0..len(sizes)` into runs of about `most` bytes; a longer item is a run of its own."""
    if len(sizes) == 0:
        return
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def split_text(text: str, most: int) -> Iterator[str]:
    """Parts of at most about `most` characters, cut only at a space or line end, which goes."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        if cut <= at:
            nxt = [p for p in (text.find(" ", at + most), text.find("\n", at + most)) if p >= 0]
            if not nxt:
                break
            cut = min(nxt)
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _wordwise(spec: dict) -> bool:
    """Whether a vocabulary file gives each space-separated word its ids independently of the others."""
    norm = spec.get("normalizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    spaces = all(s["type"] != "Replace" or s["pattern"] == {"Regex": "\\s+"} for s in steps)
    return (
        spec["model"]["type"] == "BPE"
        and bool(spec["model"].get("end_of_word_suffix"))
        and not spec["model"].get("dropout")
        and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
        and {s["type"] for s in steps} <= WORDWISE and spaces and plain
    )


def _folds(spec: dict) -> bool:
    """Whether a word-by-word vocabulary lowers letters and cuts between letters or digits and other signs."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return {"type": "Lowercase"} in steps and first.get("pattern") == {"Regex": LETTERS_APART}


def folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lowered and a space between an ASCII letter or digit and a stop right after it. No nulls."""
    data, at = raw_bytes(texts)
    data = _LOWER[data]
    cut = np.flatnonzero(_PLAIN[data[:-1]] & _STOP[data[1:]]) + 1
    cut = np.setdiff1d(cut, at, assume_unique=False)
    data = np.insert(data, cut, 32)
    at = at + np.searchsorted(cut, at)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


class WordEncoder:
    """Ids of texts under a vocabulary that drops white space, word by word."""

    def __init__(self, path: str, spec: dict):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.folds = _folds(spec)
        suffix = spec["model"]["end_of_word_suffix"]
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        special = [t for t in spec.get("added_tokens", []) if t["special"] and not t["normalized"]]
        self.mark = special[0]["content"] if special else None
        self.mark_id = special[0]["id"] if special else -1
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _forget(self) -> None:
        """Keep the half of the words that were met in most batches."""
        words = np.array(list(self.slot), object)
        kept = np.argsort(-self.met[:len(words)], kind="stable")[:MEMO_WORDS // 2]
        ids, size, start, met = self.ids, self.size[kept], self.start[kept], self.met[kept]
        self._clear()
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        self.ids = ids[np.repeat(start - (ends - size), size) + np.arange(total)]
        self.start, self.size, self.met, self.used = ends - size, size, met // 2, total
        self.slot = dict(zip(words[kept].tolist(), range(len(kept)), strict=True))

    def _whole_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters, told apart by the tokens that end a word; none if one is more than a word."""
        joined = [" ".join(words[i:i + JOINED_WORDS]) for i in range(0, len(words), JOINED_WORDS)]
        got = self.tok.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.fromiter((i for e in got for i in e.ids), np.uint32)
        ends = np.flatnonzero(self.ends_word[flat])
        return (flat, np.diff(ends, prepend=-1)) if len(ends) == len(words) else None

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        if self.mark is None or len(words) < 2:
            got = self.tok.encode_batch_fast(words, add_special_tokens=False)
            parts = [e.ids for e in got]
            return np.array([i for p in parts for i in p], np.uint32), np.array([len(p) for p in parts], np.int64)
        # Words are told apart by a special token between them, which no word of `words` contains.
        joined = [self.mark.join(words[i:i + JOINED_WORDS]) + self.mark for i in range(0, len(words), JOINED_WORDS)]
        got = self.tok.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        ends = np.flatnonzero(flat == self.mark_id)
        assert len(ends) == len(words)
        return flat[flat != self.mark_id], np.diff(ends, prepend=-1) - 1

    def _learn(self, words: list[str]) -> None:
        # A word of letters is a word at least; so many words in all are one each.
        letters = [w for w in words if w.isalpha()] if self.folds else []
        rest = [w for w in words if not w.isalpha()] if self.folds else words
        plain = [w for w in rest if self.mark is None or self.mark not in w]
        for group in (letters, plain, *([w] for w in rest if self.mark is not None and self.mark in w)):
            if not group:
                continue
            ids, sizes = (group is letters and self._whole_words(group)) or self._encode(group)
            n, k = len(self.slot), len(group)
            if n + k > len(self.start):
                grow = max(2 * len(self.start), n + k)
                self.start = np.resize(self.start, grow)
                self.size = np.resize(self.size, grow)
                self.met = np.resize(self.met, grow)
            if self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(ids)))
            self.ids[self.used:self.used + len(ids)] = ids
            self.start[n:n + k] = self.used + np.cumsum(sizes) - sizes
            self.size[n:n + k] = sizes
            self.met[n:n + k] = 0
            self.used += len(ids)
            self.slot.update(zip(group, range(n, n + k), strict=True))

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slot of every word of the texts, and where each text's words begin (one more at the end)."""
        if self.folds and SPECIAL not in raw_bytes(texts)[0].tobytes():
            texts = folded(texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slot) + len(words) > MEMO_WORDS:
            self._forget()
        new = [w for w in words if w not in self.slot]
        if new:
            self._learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        self.met[slots] += 1
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        return slots[coded.indices.to_numpy()] if len(words) else slots, np.concatenate([[0], np.cumsum(sizes)])

    def lengths(self, texts: pa.Array) -> np.ndarray:
        slots, at = self._words(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.size[slots])])[at])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        slots, at = self._words(texts)
        size = self.size[slots]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[slots] - (ends - size), size) + np.arange(total)]
        return ids, np.diff(np.concatenate([[0], ends])[at])


class TextEncoder:
    """Ids of whole texts, for vocabularies in which words depend on what stands around them."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            self.batch = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(x) for x in self.batch(texts.to_pylist())], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = self.batch(texts.to_pylist())
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)


_OPEN: dict[str, WordEncoder | TextEncoder] = {}


def encoder(name: str) -> WordEncoder | TextEncoder:
    """The encoder of a vocabulary file, opened once in each worker."""
    if name not in _OPEN:
        path = name if os.path.isabs(name) else vocabulary_path(name)
        spec = json.load(open(path, encoding="utf-8")) if path.endswith(".json") else None
        _OPEN[name] = WordEncoder(path, spec) if spec and _wordwise(spec) else TextEncoder(path)
    return _OPEN[name]


def filled(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts with null as the empty text."""
    flat = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.fill_null(flat.cast(pa.string()), "")


def encoded(name: str, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `BATCH_BYTES`: first, end, ids, ids in each. A long text's parts are put together."""
    enc = encoder(name)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for a, b in byte_slices(sizes, BATCH_BYTES):
        if sizes[a] > BATCH_BYTES and isinstance(enc, WordEncoder):
            parts = [enc.encode(pa.array([p], pa.string()))[0] for p in split_text(texts[a].as_py(), BATCH_BYTES // 4)]
            ids = np.concatenate(parts)
            yield a, b, ids, np.array([len(ids)], np.int64)
        else:
            yield a, b, *enc.encode(texts.slice(a, b - a))


def counted(name: str, texts: pa.Array) -> np.ndarray:
    """Number of ids of every text, in runs of about `BATCH_BYTES`, long texts in parts."""
    enc = encoder(name)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), np.int64)
    for a, b in byte_slices(sizes, BATCH_BYTES):
        if sizes[a] > BATCH_BYTES and isinstance(enc, WordEncoder):
            out[a] = sum(int(enc.lengths(pa.array([p], pa.string()))[0]) for p in split_text(texts[a].as_py(), BATCH_BYTES // 4))
        else:
            out[a:b] = enc.lengths(texts.slice(a, b - a))
    return out
