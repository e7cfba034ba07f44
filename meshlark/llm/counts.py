"""Token counts by a finite-state transducer compiled from a BPE tokenizer file.

For BPE, tokens next to each other are those of the whole word if and only if each neighbouring pair encodes to
itself. So reading a word symbol by symbol, the last token of what was read follows from the last tokens at the few
places where a token still under way may have begun. A state is this set of places: the node of the token under way
in the trie of all tokens, the token before it, and how many tokens came before, counted from the smallest such
number, which the transition into the state has emitted. The states are finite, each symbol has one next state, and
transitions are compiled when first met. The last symbol of a word, which carries the word-end mark, emits the rest.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions.worker import once, ship
from meshlark.llm.held import Settled

ship(__name__)
CHUNK = 1 << 15  # code points
FAN = 64  # chunk maps composed in one step
STEPS = 3  # CHUNK * FAN ** STEPS exceeds any string
STATES = 200_000  # compiled states that a worker keeps
HELD = 200_000  # words whose count a worker keeps


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Transducer:
    """Counts a word's tokens. Symbols are bytes; a word's last byte is a symbol of its own, 256 higher."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: list[str], suffix: str):
        byte_of = byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            ends = bool(suffix) and token.endswith(suffix)
            out = [byte_of[x] for x in (token[:-len(suffix)] if ends else token)]
            return (*out[:-1], out[-1] + 256) if ends else tuple(out)

        self.number_of: dict[tuple[int, ...], int] = {}
        self.symbols_of: list[tuple[int, ...]] = []
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for k, word in enumerate(vocabulary):
            self.symbols_of.append(symbols(word))
            self.number_of[self.symbols_of[k]] = k
            node = 0
            for s in self.symbols_of[k]:
                node = self.trie[node].setdefault(s, len(self.trie))
                if node == len(self.token):
                    self.trie.append({})
                    self.token.append(None)
            self.token[node] = k
        number = self.number_of
        self.merge = {}  # neighbours to (rank, token)
        for k, (a, b) in enumerate(merges):
            a, b = symbols(a), symbols(b)
            self.merge[number[a], number[b]] = (k, number[a + b])
        self.pairs: dict[tuple, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, word: tuple[int, ...]) -> list[int]:
        """Plain BPE: symbols to tokens."""
        parts, get = [self.number_of[s,] for s in word], self.merge.get
        while True:
            found = [m for m in map(get, zip(parts, parts[1:])) if m]
            if not found:
                return parts
            best = min(found)
            at = next(k for k, pair in enumerate(zip(parts, parts[1:])) if get(pair) == best)
            parts[at:at + 2] = [best[1]]

    def _fits(self, before: int | None, token: int) -> bool:
        if before is None:
            return True
        if (known := self.pairs.get((before, token))) is None:
            known = self.pairs[before, token] = self.merged(self.symbols_of[before] + self.symbols_of[token]) == [before, token]
        return known

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """Compile one transition: (next state, emitted tokens). After a word's last symbol the next state is the first."""
        under_way, ended = [], None
        for node, before, n in self.states[state]:
            child = self.trie[node].get(symbol)
            if child is None:
                continue
            token = self.token[child]
            if token is not None and self._fits(before, token):
                ended = (0, token, n + 1)
            if self.trie[child]:
                under_way.append((child, before, n))
        if symbol >= 256:
            found = (0, ended[2])
        else:
            places = [*under_way, ended]
            sure = min(n for _, _, n in places)
            following = tuple((node, before, n - sure) for node, before, n in places)
            if following not in self.number:
                self.number[following] = len(self.states)
                self.states.append(following)
                self.steps.append({})
            found = (self.number[following], sure)
        self.steps[state][symbol] = found
        return found

    def count(self, word: bytes) -> int:
        if len(self.states) > STATES:
            self._reset()
            self.pairs.clear()
        state = total = 0
        for symbol in (*word[:-1], word[-1] + 256):
            state, emitted = self.steps[state].get(symbol) or self._step(state, symbol)
            total += emitted
        return total


class Counter:
    """Token counts of texts for a file of the tokenizers library: BPE with word ends, lower-cased, white space dropped.

    Texts of settled characters are normalised and split here; others by the library's own normaliser and splitter.
    """

    def __init__(self, content: bytes):
        import regex
        from tokenizers import Tokenizer

        says = json.loads(content)
        model, split = says["model"], says["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in says["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError("a BPE file with word ends, lower-cased, is needed")
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.transducer = Transducer(merges, list(model["vocab"]), model["end_of_word_suffix"])
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        specials = [x["content"] for x in says["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.held: dict[str, int] = {}
        library = Tokenizer.from_str(content.decode())
        self.normalise, self.split, self.byte_of = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str, byte_letters()
        self.settled = Settled()

    def _learn(self, word: str) -> int:
        if len(self.held) >= HELD:
            self.held.clear()
        n = self.held[word] = self.transducer.count(word.encode())
        return n

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string in it is that token."""
        if self.special and self.special.search(text):
            return sum(map(self._count, self.special.split(text))) + len(self.special.findall(text))
        return self._count(text)

    def _count(self, text: str) -> int:
        if not text.isascii():
            if not self.settled.all_of(text):
                pieces = [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in self.split(self.normalise(text))]
                return sum(map(self.transducer.count, pieces))
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing goes letter by letter there
        get, learn = self.held.get, self._learn
        return sum([get(w) or learn(w) for w in self.words(text.lower())])


class Map:
    """What a stretch of text does to any state: a head that ends the entry state's word, a count, an open tail.

    Between words the state is the first one whatever came before. So the map of entry state to exit state and count
    is this: go on from the entry state over the head, add the count of what lies between the first and the last
    blank, and leave in the state that the tail leads to. Without a blank the whole stretch is head.
    """

    BLANK = re.compile("[ \n]")

    @classmethod
    def of(cls, text: str, counter: Counter) -> tuple[str, int, str, bool]:
        first = cls.BLANK.search(text)
        if not first:
            return text, 0, "", False
        last = max(text.rfind(" "), text.rfind("\n"))
        return text[:first.start()], counter.count(text[first.start():last]), text[last:], True

    @staticmethod
    def compose(a: tuple, b: tuple, counter: Counter) -> tuple[str, int, str, bool]:
        if not a[3]:
            return (a[0] + b[0], *b[1:])
        if not b[3]:
            return (*a[:2], a[2] + b[0], True)
        return a[0], a[1] + counter.count(a[2] + b[0]) + b[1], b[2], True

    @staticmethod
    def total(m: tuple, counter: Counter) -> int:
        """The count when entered, and left, between words."""
        return counter.count(m[0]) + m[1] + counter.count(m[2])


class File:
    """A tokenizer file's bytes, read on the driver, for tasks."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            content = f.read()
        self._shared, self._key = spark.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()

    def counter(self) -> Counter:
        return once(("counter", self._key), lambda: Counter(self._shared.value))


MAPS = "key binary, part long, head string, n long, tail string, broken boolean"
_MAPS = pa.schema([
    ("key", pa.binary()), ("part", pa.int64()), ("head", pa.string()), ("n", pa.int64()), ("tail", pa.string()), ("broken", pa.bool_())])


def _cut(chunk: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                parts = range(-(-len(text) // chunk))
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[k].as_py()] * len(parts), pa.binary()), pa.array(parts, pa.int64()),
                    pa.array([text[p * chunk:(p + 1) * chunk] for p in parts])], ["key", "part", "chunk"])

    return cut_up


def _map(file: File):
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = file.counter()
        for batch in batches:
            found = [Map.of(x, counter) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), list(_MAPS)[2:], strict=True))], schema=_MAPS)

    return maps


def _compose(file: File):
    """Rows of (key, part, maps in order) to one map each."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = file.counter()
        for batch in batches:
            for key, part, maps in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                m = ("", 0, "", False)
                for x in maps:
                    m = Map.compose(m, (x["head"], x["n"], x["tail"], x["broken"]), counter)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((key, part, *m), _MAPS, strict=True)], schema=_MAPS)

    return compose


def _total(file: File):
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = file.counter()
        for batch in batches:
            rows = zip(*(x.to_pylist() for x in batch.columns), strict=True)
            n = [Map.total(m, counter) for _, _, *m in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["key", "n_tokens"])

    return total


def _counts(file: File):
    @F.arrow_udf("long")
    def counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = file.counter()
        for part in texts:
            yield pa.array([counter.count(x) for x in part.to_pylist()], pa.int64())

    return counts


def count_tokens(docs: DataFrame, file: File, limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``, over its whole text.

    Texts of one chunk are counted where they are. Longer ones are cut into chunks that are dealt out over the
    cluster; each becomes a state map, and the maps of one text compose in three steps, 64 neighbours at a time.
    Rows of one long text and id are counted once and multiplied. Null text counts as empty; special tokens' strings
    inside texts count as those tokens; an empty table gives no rows; other columns are dropped.
    """
    bare = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    short = bare.filter(F.length("text") <= chunk).select("doc_id", n_bytes, _counts(file)("text").alias("n_tokens"))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.hex(F.col("doc_id").cast("long")), F.lit("-")), F.lit("/"), F.col("text")), 256))
    long = bare.filter(F.length("text") > chunk).groupBy(key.alias("key")).agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    maps = long.select("key", "text").mapInArrow(_cut(chunk), "key binary, part long, chunk string").repartition("key", "part").mapInArrow(_map(file), MAPS)
    for _ in range(STEPS):
        near = maps.groupBy("key", F.floor(F.col("part") / FAN).alias("part")).agg(F.sort_array(F.collect_list(
            F.struct("part", "head", "n", "tail", "broken"))).alias("maps"))
        maps = near.mapInArrow(_compose(file), MAPS)
    totals = maps.mapInArrow(_total(file), "key binary, n_tokens long")
    whole = totals.join(long.select("key", "doc_id", n_bytes, "copies"), "key").select(
        "doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
    return short.unionByName(whole).withColumn("over_limit", F.col("n_tokens") > limit)
