"""Byte-level BPE over Arrow string columns with the ``tokenizers`` library.

The library spends most of its time on words it has met before, so texts are cut into pieces, the distinct pieces of a
batch are found by Arrow's dictionary encoding, and only those that this worker doesn't remember go through the tokenizer.
Cuts are made only where the byte-level pre-tokenizer cuts as well, so the ids are those of the library over the whole text:

* before a space that is followed by something other than white space,
* between an ASCII letter or digit and a following mark that isn't an apostrophe,
* around a single line break between ASCII characters that aren't white space.

Texts that hold the name of an added token (``<|endoftext|>``, which the library reads as that token) are encoded whole.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the pieces remembered by one Python worker may take, in each of two generations.
CACHE_BYTES = 16 << 20
#: What a remembered piece takes besides its bytes and ids.
ENTRY_BYTES = 150
#: Bytes of text that are cut into pieces at once; a longer text goes alone.
CHUNK_BYTES = 4 << 20
#: How the byte-level alphabet writes a space; ASCII letters stand for themselves.
SPACE = "\u0120"
#: Classes of bytes: 1 letters and digits, 2 marks that end a word, 3 other ASCII characters that aren't white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[list(b",.;:!?#*$%&|<>()\"-=+/")] = 2
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
#: Beyond ASCII, the first bytes of white space among other characters; a space before one of them is no place to cut.
_CLASS_AFTER_SPACE = (_CLASS > 0) | (np.arange(256) >= 0x80) & ~np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder, with its memory, for each worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Recent:
    """Pieces and their ids in two generations: what isn't asked for while a generation fills is forgotten with the next."""

    def __init__(self, limit: int):
        self.limit, self.size = limit, 0
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def get(self, pieces: list[bytes]) -> list[bytes | None]:
        found = list(map(self.new.get, pieces))
        if self.old:
            again = {i: self.old[pieces[i]] for i, x in enumerate(found) if x is None and pieces[i] in self.old}
            for i, ids in again.items():
                found[i] = ids
            self.add([pieces[i] for i in again], list(again.values()))
        return found

    def add(self, pieces: list[bytes], ids: list[bytes]) -> None:
        self.new.update(zip(pieces, ids, strict=True))
        self.size += sum(map(len, pieces)) + sum(map(len, ids)) + ENTRY_BYTES * len(pieces)
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        if not isinstance(self.tokenizer.pre_tokenizer, ByteLevel) or self.tokenizer.normalizer is not None:
            raise ValueError(f"{path} is no byte-level tokenizer without a normalizer")
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocabulary <= 65536 else np.dtype("<u4")
        self.pack = [struct.Struct(f"<{n}{'H' if self.dtype.itemsize == 2 else 'I'}").pack for n in range(32)]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = Recent(CACHE_BYTES)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64)) // CHUNK_BYTES
        starts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        done = [self._encode(texts.slice(a, b - a)) for a, b in zip(starts, starts[1:]) if b > a]
        pa.default_memory_pool().release_unused()
        if not done:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(len(texts), bool)
        for name in self.added:
            whole |= np.asarray(pc.match_substring(texts, name))
        if not whole.any():
            return self._pieces(texts)
        ids, counts = self._pieces(texts.filter(pa.array(~whole)))
        rest = self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)
        plain, full, out = iter(np.split(ids, np.cumsum(counts)[:-1])), iter(rest), []
        for w in whole:
            out.append(np.asarray(next(full).ids, dtype=self.dtype) if w else next(plain))
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        begin, end = int(offsets[0]), int(offsets[-1])
        if begin == end:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        values = texts.buffers()[2].slice(begin, end - begin)
        here = cuts(np.frombuffer(values, np.uint8))
        here[offsets - begin] = True
        starts = np.flatnonzero(here)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), values]).dictionary_encode()
        encoded = self._known(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // self.dtype.itemsize
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(encoded), self.dtype)))
        ids = np.asarray(lists.take(pieces.indices).flatten())
        ends = np.concatenate([[0], np.cumsum(sizes[np.asarray(pieces.indices)])])
        return ids, np.diff(ends[np.searchsorted(starts, offsets - begin)])

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; what isn't remembered is encoded."""
        found = self.memory.get(pieces)
        new = [i for i, ids in enumerate(found) if ids is None]
        ids = self._fresh([pieces[i] for i in new])
        for i, x in zip(new, ids, strict=True):
            found[i] = x
        self.memory.add([pieces[i] for i in new], ids)
        return found

    def _fresh(self, pieces: list[bytes]) -> list[bytes]:
        """Encode each piece. A run of ASCII letters, with or without a space before it, is one pre-token and goes to the
        model as it is (where a space is written ``SPACE``); others go through the whole tokenizer."""
        out: list[bytes] = [b""] * len(pieces)
        tokenize, pack, others = self.tokenizer.model.tokenize, self.pack, []
        for i, x in enumerate(pieces):
            if x.isalpha():
                ids = [t.id for t in tokenize(x.decode())]
            elif x[0] == 32 and x[1:].isalpha():
                ids = [t.id for t in tokenize(SPACE + x[1:].decode())]
            else:
                others.append(i)
                continue
            out[i] = pack[len(ids)](*ids) if len(ids) < len(pack) else np.asarray(ids, self.dtype).tobytes()
        found = self.tokenizer.encode_batch_fast([pieces[i].decode() for i in others], add_special_tokens=False)
        for i, e in zip(others, found, strict=True):
            out[i] = np.asarray(e.ids, self.dtype).tobytes()
        return out


def cuts(b: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte of texts that stand one after another (their own starts aside), and one more."""
    kind, n = _CLASS[b], len(b)
    here = np.zeros(n + 1, bool)
    here[: n - 1] = (b[:-1] == 32) & _CLASS_AFTER_SPACE[b[1:]]
    here[1:n] |= (kind[1:] == 2) & (kind[:-1] == 1)
    line = np.flatnonzero(b == 10)
    line = line[(line > 0) & (line < n - 1)]
    line = line[(kind[line - 1] > 0) & (kind[line + 1] > 0)]
    here[line] = here[line + 1] = True
    return here
