"""Token ids of whole texts by the tokenizers library, a run of non-space characters at a time.

The vocabulary's pre-tokenizer drops white space and no rule looks past it, nor does a special token hold any, so the
ids of a text are those of its runs one after another. A worker keeps the ids of the runs it met (a bounded memo), so
the library sees each of them about once. Texts with U+001C to U+001F, which Python alone counts as white space, go to
the library whole.

A plain run, of printable ASCII and letters of Latin-1, is lower-cased and split here as the vocabulary's normalizer and
pre-tokenizer would (both read from its file; another vocabulary's runs all take the library's whole way), and its pieces
go to the library's model alone, which takes a fifth of the time.
"""

from __future__ import annotations

import array
import contextlib
import json
import re
import sys
from collections.abc import Iterator

from affilink.llm.shared import vocabulary_path

#: What the memo may take: a run counts its own bytes, its ids' and ENTRY_BYTES.
MEMO_BYTES = 48 << 20
ENTRY_BYTES = 190
LONGEST_KEPT = 64
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: The normalizer and the split that _PLAIN and _PIECES repeat for plain runs.
_KNOWN_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_encoders: dict[str, RunEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, run: str) -> bytes:
        ids = self.encode(run)
        if len(run) <= LONGEST_KEPT:
            self[run] = ids
            self.held += len(run) + len(ids) + ENTRY_BYTES
        return ids

    def clear(self) -> None:
        super().clear()
        self.held = 0


class RunEncoder:
    """encode(text): the ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo_bytes = memo_bytes
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        rules = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        special = [x["content"] for x in rules["added_tokens"]]
        repeated = steps == _KNOWN_NORMALIZER and splits == [_KNOWN_SPLIT, None] and all(x.startswith("<|") for x in special)
        self.memo = _Memo(self.run if repeated else self.whole)

    def whole(self, text: str) -> bytes:
        ids = array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def run(self, run: str) -> bytes:
        if not _PLAIN.fullmatch(run) or "<|" in run or len(run) > LONGEST_KEPT:
            return self.whole(run)
        ids = array.array("I")
        for piece in _PIECES.findall(run.lower()):
            ids.extend([t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self.whole(text)
        if self.memo.held > self.memo_bytes:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, text.split()))


@contextlib.contextmanager
def encoder(vocabulary: str) -> Iterator[RunEncoder]:
    """One encoder a worker and vocabulary; its memo ends with its use, so that a reused worker is small again."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = RunEncoder(vocabulary)
    try:
        yield _encoders[vocabulary]
    finally:
        _encoders[vocabulary].memo.clear()
