"""Token ids of whole texts, with the pieces between ASCII white space encoded once and kept.

The tokenizer's file splits at white space before it merges, so a text's ids are those of its white-space pieces, one after the
other. Arrow cuts a slice of texts into pieces and numbers the different ones; a worker keeps the ids of the short pieces that it has met (up
to a bound, then it starts anew), hands only new ones to the library, and gathers the slice's ids by the numbers. A piece that is
letters and then signs is the ids of its letters and of its signs, since the tokenizer splits between them too; Latin letters go to the
library's merges directly. Everything goes to the library whole if the tokenizer is not one that drops white space.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
_KEPT = 300_000
_LONG = 64
#: Bytes of text that are cut into pieces at a time (a longer text is cut alone).
_SLICE = 2 << 20
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: Byte-level alphabet: bytes that are no printable Latin-1 characters are named by code points from 256.
_SAME = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SAME)}
_TAIL = ".,;:!?*#$%&"
_MADE: dict[str, TextEncoder] = {}


class TextEncoder:
    """One per worker and file: TextEncoder.of(path)."""

    def __init__(self, path: str, kept: int = _KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = json.dumps(spec.get("pre_tokenizer"))
        self.whole = not ('"Removed"' in steps and r"[^\\s" in steps and '"invert": true' in steps)
        # A special token that reaches over white space, or takes some with it, is found in whole texts only.
        self.whole |= any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["content"].split() != [x["content"]] for x in spec.get("added_tokens", []))
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = _Known(self, '"ByteLevel"' in steps and '"Lowercase"' in json.dumps(spec.get("normalizer")))

    @staticmethod
    def of(path: str, kept: int = _KEPT) -> TextEncoder:
        """This worker's encoder, which keeps as many pieces from now on."""
        if path not in _MADE:
            _MADE[path] = TextEncoder(path)
        _MADE[path].kept = kept
        return _MADE[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.type).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text, without the end id."""
        flat, lengths = self.column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.empty(0, self.type), np.empty(0, np.int64)
        size, cuts, at = np.cumsum(pc.binary_length(texts).to_numpy()), [0], 0
        while cuts[-1] < len(texts):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(size, at + _SLICE, side="right"))))
            at = int(size[cuts[-1] - 1])
        found = [self._slice(texts.slice(lo, hi - lo)) for lo, hi in zip(cuts, cuts[1:])]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.whole:
            got = self._ids(texts.to_pylist())
            return np.frombuffer(b"".join(got), self.type), np.fromiter(map(len, got), np.int64, len(got)) // self.type.itemsize
        if len(self.known) > self.kept:
            self.known.clear()
        pieces = pc.ascii_split_whitespace(texts)
        numbered = pieces.flatten().dictionary_encode()
        # One string of all pieces makes Python strings faster than Arrow does; no piece holds a newline.
        words = numbered.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar("\n", pa.large_string()))
        got = list(map(self.known.__getitem__, joined[0].as_py().split("\n")))
        own = np.fromiter(map(len, got), np.int64, len(got)) // self.type.itemsize
        begins, number = np.cumsum(own) - own, numbered.indices.to_numpy()
        many = own[number]
        ends = np.cumsum(many)
        places = np.repeat(begins[number] - (ends - many), many)
        places += np.arange(len(places))
        flat = np.frombuffer(b"".join(got), self.type)[places]
        bounds = pieces.offsets.to_numpy()
        return flat, np.diff(np.concatenate(([0], ends))[bounds - bounds[0]])


class _Known(dict):
    """Ids of white-space pieces, found out when first asked for."""

    def __init__(self, encoder: TextEncoder, latin: bool):
        self.encoder, self.merge, self.word, self.char = encoder, encoder.tokenizer.model.tokenize, _LATIN.fullmatch if latin else (lambda x: None), encoder.type.char

    def __missing__(self, piece: str) -> bytes:
        if not piece:
            return b""
        base = piece.rstrip(_TAIL)
        if not self.word(base):
            ids = self.encoder._ids([piece])[0]
        elif len(base) < len(piece):
            ids = self[base] + self[piece[len(base) :]]
        else:
            # A run of Latin letters is one piece of the tokenizer, already composed: only its bytes are renamed before the merges.
            raw = piece.lower().encode()
            name = raw.decode() if raw.isascii() else raw.decode("latin-1").translate(_BYTES)
            ids = array(self.char, [x.id for x in self.merge(name)]).tobytes()
        if len(piece) <= _LONG:
            self[piece] = ids
        return ids
