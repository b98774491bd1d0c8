"""Token counts by a tokenizer compiled to finite-state transducers.

Byte-pair encoding of a prefix is that of a shorter prefix and one more token, its last; and a token may follow another
exactly when the two, written together, are encoded as these two. So the last token at a byte, and the change of the
number of tokens there, follow from the byte and a bounded context: the last tokens at those earlier places from which
the bytes read so far could still become a token. These contexts are the states of a deterministic transducer whose
transitions carry the change of the count; places that no token can reach any more drop out, so states recur. States are
made when a text first needs them and thrown away together when there are too many, like those of a lazy regular
expression matcher. A second, small automaton over classes of characters cuts texts into the pieces that the vocabulary's
pre-tokenizer makes; a character's class is read from that pre-tokenizer itself.

No piece reaches over the start of a run of white space, so both automata are in one state there. A chunk of a text
is therefore a short map: what stands before its first such place, the tokens between its first and last, and what
stands behind. Maps compose associatively, and a parallel prefix scan of doubling steps gives the count at the end of
every chunk. Runs of characters between such places are macro transitions, kept by a worker in a bounded memo.

Special strings count as the one token they are. Null and empty texts have none. Repeated rows are counted each. A null
doc_id stays null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affilink.llm.shared import table, vocabulary_path
from affilink.llm.tokenizing import byte_letters

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 1 << 14
MEMO_RUNS = 400_000
LONGEST_KEPT = 64
MOST_STATES = 200_000
MOST_PAIRS = 1_000_000
_RUNS = re.compile(r"\s*\S+|\s+")
_PLACE = re.compile(r"(?<=\S)\s")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_START = -1
#: The endings that the pre-tokenizer cuts off, and the split it must be.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_counters: dict[str, Counter] = {}


class Transducer:
    """Counts of byte-pair tokens of pieces; see the module's text."""

    def __init__(self, model, vocabulary: dict[str, int]):
        self.model, self.letters = model, byte_letters()
        back = {c: b for b, c in self.letters.items()}
        self.bytes_of: dict[int, bytes] = {}
        self.trie: dict[int, int] = {}
        self.token: list[int] = [-1]
        for text, number in vocabulary.items():
            if not all(c in back for c in text) or [t.id for t in model.tokenize(text)] != [number]:
                continue  # no text is encoded as this
            raw = bytes(back[c] for c in text)
            self.bytes_of[number] = raw
            node = 0
            for b in raw:
                key = node << 8 | b
                if key not in self.trie:
                    self.trie[key] = len(self.token)
                    self.token.append(-1)
                node = self.trie[key]
            self.token[node] = number
        self.pairs: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """States anew: 0 is the start of a piece. A state: the last token, and (node, last token there, count there less the count here) of live places."""
        self.states: list[tuple[int, tuple]] = [(_START, ())]
        self.numbers = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def follows(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            text = "".join(self.letters[x] for x in self.bytes_of[a] + self.bytes_of[b])
            known = self.pairs[a, b] = [t.id for t in self.model.tokenize(text)] == [a, b]
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the change of the count."""
        last, live = self.states[state]
        after, found, change = [], None, 0
        for node, before, count in (*live, (0, last, 0)):
            node = self.trie.get(node << 8 | byte, 0)
            if not node:
                continue
            token = self.token[node]
            if found is None and token >= 0 and (before == _START or self.follows(before, token)):
                found, change = token, count + 1
            after.append((node, before, count))
        if found is None:
            raise ValueError(f"no token ends at byte {byte}")
        key = (found, tuple((n, b, c - change) for n, b, c in after))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        self.steps[state][byte] = (number, change)
        return number, change

    def count(self, piece: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.forget()
        steps, state, total = self.steps, 0, 0
        for byte in piece:
            state, change = steps[state].get(byte) or self.step(state, byte)
            total += change
        return total


class ChunkMap(NamedTuple):
    """What a chunk does to a count. tokens is None if it holds no place where the state is known; head is then all of it."""

    head: str
    tokens: int | None
    tail: str


class Counter:
    """count(text): the number of the library's tokens."""

    def __init__(self, vocabulary: str, memo_runs: int = MEMO_RUNS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        rules = json.loads(self.tokenizer.to_str())
        cut = rules["pre_tokenizer"] or {}
        if rules["normalizer"] or (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("only byte-level vocabularies with the usual split are compiled")
        special = [x["content"] for x in rules["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.transducer = Transducer(self.tokenizer.model, self.tokenizer.get_vocab(with_added_tokens=False))
        self.classes: dict[str, str] = {}
        self.memo_runs = memo_runs
        count = self.run

        class Memo(dict):
            def __missing__(memo, run: str) -> int:  # noqa: N805
                n = count(run)
                if len(run) <= LONGEST_KEPT:
                    memo[run] = n
                return n

        self.memo = Memo()

    def class_of(self, c: str) -> str:
        """L letter, N number, S white space, O other, as the vocabulary's pre-tokenizer has it."""
        kind = self.classes.get(c)
        if kind is None:
            pieces = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
            kind = "L" if pieces(f"a{c}a") == 1 else "N" if pieces(f"1{c}1") == 1 else "O" if pieces(f"!{c}!") == 1 else "S"
            self.classes[c] = kind
        return kind

    def pieces(self, text: str) -> Iterator[str]:
        """The pre-tokenizer's pieces, by an automaton over classes of characters."""
        kinds = [self.classes.get(c) or self.class_of(c) for c in text]
        at, n = 0, len(text)
        while at < n:
            first, kind = at, kinds[at]
            if text[at] == "'":
                ending = next((e for e in _ENDINGS if text.startswith(e, at + 1)), None)
                if ending:
                    at += 1 + len(ending)
                    yield text[first:at]
                    continue
            if kind == "S":
                end = at
                while end < n and kinds[end] == "S":
                    end += 1
                if end == n or end - at > 1:
                    # all of it at the end, else all but the last, which may lead the next piece
                    at = end if end == n else end - 1
                    yield text[first:at]
                    continue
                if text[at] != " ":
                    at += 1
                    yield text[first:at]
                    continue
                at, kind = end, kinds[end]
            while at < n and kinds[at] == kind:
                at += 1
            yield text[first:at]

    def run(self, text: str) -> int:
        count = self.transducer.count
        return sum(count(p.encode()) for p in self.pieces(text))

    def between(self, text: str) -> int:
        """Tokens of a text that starts and ends where the state is known."""
        if len(self.memo) > self.memo_runs:
            self.memo.clear()
        return sum(map(self.memo.__getitem__, _RUNS.findall(text)))

    def chunk(self, text: str) -> ChunkMap:
        first = _PLACE.search(text)
        if first is None:
            return ChunkMap(text, None, "")
        p, q = first.start(), first.start()
        last = len(text.rstrip())  # a run of white space at the end starts a place too
        if last < len(text) and last > p:
            q = last
        else:
            word = re.search(r"\s+\S*\Z", text)
            q = max(p, word.start()) if word else p
        return ChunkMap(text[:p], self.between(text[p:q]), text[q:])

    def composed(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks."""
        left = a.head if a.tokens is None else a.tail
        if left and b.head and not left[-1].isspace() and b.head[0].isspace():
            # the cut itself is a place
            known = (0 if a.tokens is None else a.tokens + self.between(left), 0 if b.tokens is None else self.between(b.head) + b.tokens)
            return ChunkMap(a.head, sum(known), b.head if b.tokens is None else b.tail)
        if a.tokens is None:
            return ChunkMap(a.head + b.head, b.tokens, b.tail)
        if b.tokens is None:
            return ChunkMap(a.head, a.tokens, a.tail + b.head)
        return ChunkMap(a.head, a.tokens + self.between(a.tail + b.head) + b.tokens, b.tail)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """The maps of all prefixes, by doubling steps; within a step no map waits for another."""
        reach = 1
        while reach < len(maps):
            maps = [self.composed(maps[k - reach], m) if k >= reach else m for k, m in enumerate(maps)]
            reach *= 2
        return maps

    def total(self, m: ChunkMap) -> int:
        return self.between(m.head) + (0 if m.tokens is None else m.tokens + self.between(m.tail))

    def segment(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text without special strings."""
        if _ODD_SPACE.search(text):
            return self.run(text)  # Python's white space isn't the pre-tokenizer's
        if len(text) <= chunk:
            return self.between(text)
        return self.total(self.scan([self.chunk(text[k : k + chunk]) for k in range(0, len(text), chunk)])[-1])

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.segment(text, chunk)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.segment(p, chunk) for p in parts)


def counter(vocabulary: str) -> Counter:
    """One counter a worker and vocabulary."""
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes and n_tokens of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes, counts = [len(t.encode()) if t else 0 for t in texts], [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
