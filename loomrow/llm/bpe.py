"""BPE as a streaming transducer: tokens leave as soon as no later letter can change them.

A sequence of tokens is the encoding of its text exactly if every token is the encoding of itself and
every two neighbours are the encoding of their joint text: merges never cross a boundary that stays, so
neighbours decide alone. For each prefix of a text there is one such sequence. The encoder keeps, for each
of the last positions, the one token that ends there in the encoding of the text so far, and emits the
tokens that lie on the paths of all live positions. The next token begins at most the longest token's
length back, so only that window is alive, and the paths meet within the *lookahead* of the merge list.

Decoding is the reverse machine: ids become bytes, and bytes become text once a character is whole.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import beyond_latin, kept, latin_pattern, quoted, slices, table, unpacked, whole_row

TOKENIZER = "word_bpe_49k.json"
#: words whose tokens each Python process remembers; a full memory is emptied
MEMORY_WORDS = 400_000
#: pairs of tokens of which it remembers whether they may stand side by side, and as many strings that are a token or not
MEMORY_PAIRS = 200_000
#: words of more letters are not remembered
LONG_WORD = 64
#: bytes of text handled at a time
SLICE_BYTES = 4 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known(dict):
    """Answers that were worked out before; a full memory is emptied."""

    def __init__(self, answer):
        super().__init__()
        self.answer = answer

    def __missing__(self, asked):
        found = self.answer(asked)
        if len(self) >= MEMORY_PAIRS:
            self.clear()
        self[asked] = found
        return found


class MergeList:
    """The vocabulary and merges of a byte-level BPE model with an optional mark at the end of words."""

    def __init__(self, model: dict):
        self.mark: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.letters = byte_letters()
        self.longest = max(len(self.symbols(t)) for t in self.vocab)
        self.known = Known(self.encodes)
        self.whole = Known(lambda token: token in self.vocab and self.encodes(("", token)))

    def symbols(self, token: str) -> list[str]:
        """The letters of a token, the mark joined to the last one."""
        if self.mark and token.endswith(self.mark) and token != self.mark:
            body = token[: -len(self.mark)]
            return [*body[:-1], body[-1] + self.mark]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge by rank, the leftmost of equal rank first, until nothing merges."""
        rank, none = self.rank.get, len(self.rank)
        parts = list(symbols)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def encodes(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        symbols = (self.symbols(left) if left else []) + self.symbols(right)
        return self.merged(symbols) == ([left, right] if left else [right])

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens (the left one may be empty) are the encoding of their joint text."""
        return self.known[left, right]

    def lookahead(self) -> int:
        """Letters after a position that are enough to know whether a token boundary there stays.

        What merges before a position depends on what lies behind it only through a merge that crosses it,
        and of these only on those of smaller rank; that merge depends in turn on crossings of its own end
        by merges of still smaller rank. So the reach of each merge follows from those before it: its own
        end overlaps the beginning of an earlier one by some letters, which adds the rest of that one and its reach.
        """
        beyond: dict[tuple[str, ...], int] = {}
        furthest = 0
        for left, right in self.rank:
            letters = tuple(self.symbols(left + right))
            reach = max((beyond.get(letters[i:], 0) for i in range(len(letters))), default=0)
            for i in range(1, len(letters)):
                added = len(letters) - i + reach
                if added > beyond.get(letters[:i], 0):
                    beyond[letters[:i]] = added
            furthest = max(furthest, len(letters) - 1 + reach)
        return furthest


class Encoder:
    """The transducer: push letters, take the tokens that are certain, finish the word."""

    #: letters between two looks for certain tokens
    EVERY = 16

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        # a node is (token that ends here, node where it begins); the root stands for what has left
        self.nodes: list[tuple | None] = [("", None)]
        self.tail: list[str] = []
        self.seen = 0

    def push(self, symbol: str) -> list[str]:
        """Take one letter; give the tokens that have become certain, often none."""
        merges, tail, nodes = self.merges, self.tail, self.nodes
        whole, known = merges.whole, merges.known
        tail.append(symbol)
        self.seen += 1
        token, node = "", None
        for letter, before in zip(reversed(tail), reversed(nodes)):
            token = letter + token
            if before is not None and whole[token] and (not before[0] or known[before[0], token]):
                node = (token, before)
                break
        nodes.append(node)
        if len(nodes) > merges.longest:
            del nodes[: -merges.longest], tail[: -merges.longest]
        return self.certain() if self.seen % self.EVERY == 0 else []

    def certain(self) -> list[str]:
        """Tokens on the paths of all live positions; all but the last of them leave."""
        paths = []
        for node in self.nodes:
            if node is not None:
                path = []
                while node is not None:
                    path.append(node)
                    node = node[1]
                paths.append(path[::-1])
        shared = 0
        while all(len(path) > shared for path in paths) and len({id(path[shared]) for path in paths}) == 1:
            shared += 1
        if shared < 2:
            return []
        last = paths[0][shared - 1]
        copies: dict[int, tuple] = {id(last): (last[0], None)}
        for path in paths:
            for node in path[shared:]:
                if id(node) not in copies:
                    copies[id(node)] = (node[0], copies[id(node[1])])
        self.nodes = [None if node is None else copies[id(node)] for node in self.nodes]
        # the root keeps its token, which the next neighbour must fit, until another takes its place
        return [node[0] for node in paths[0][: shared - 1] if node[0]]

    def finish(self) -> list[str]:
        """The tokens that were still open."""
        node, out = self.nodes[-1], []
        if node is None:
            raise ValueError("the text ends in a letter that no token holds")
        while node is not None:
            out.append(node[0])
            node = node[1]
        self.reset()
        return [token for token in reversed(out) if token]


class Memory(dict):
    """Ids of words seen lately."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encode(word)
        if len(word) <= LONG_WORD:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Tokenizer:
    """A tokenizer file's normaliser and word pattern, with the transducer as its model."""

    def __init__(self, content: str):
        from tokenizers import Regex
        from tokenizers import Tokenizer as Parts
        from tokenizers.pre_tokenizers import Split

        described = json.loads(content)
        self.normalizer = Parts.from_str(content).normalizer
        self.merges = MergeList(described["model"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        steps = described["pre_tokenizer"]["pretokenizers"]
        split = next(s for s in steps if s["type"] == "Split")
        self.found = regex.compile(split["pattern"]["Regex"], regex.V0).findall
        self.split = Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.beyond = regex.compile(f"[{self.differing()}\U00010000-\U0010ffff]").search
        plain = latin_pattern(split["pattern"]["Regex"])
        same = plain and not any(map(self.beyond, map(chr, range(0x80, 0x250))))
        self.plain = plain.findall if same else None
        self.lead = commonprefix(list(self.special))
        own = described["normalizer"]
        known = [s["type"] for s in own.get("normalizers", [own])] if own else []
        self.lowers = bool(known) and set(known) <= {"NFC", "NFKC", "Replace", "Lowercase"} and known[-1] == "Lowercase"
        self.encoder = Encoder(self.merges)
        self.memory = Memory(self.word_ids)
        pieces = {i: token for token, i in self.merges.vocab.items()} | {i: text for text, i in self.special.items()}
        self.pieces = [pieces.get(i, "") for i in range(max(pieces) + 1)]
        self.numbers = [str(i) for i in range(len(self.pieces))]

    def differing(self) -> str:
        """Characters of the basic plane that the library's Unicode and ours class differently; beyond it the library cuts words."""
        chars = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
        out = set()
        for first in ("a{}", "{0}{0}"):  # a letter joins a letter, a digit stands alone
            pairs = [first.format(c) for c in chars]
            theirs = [0] * len(pairs)
            for _, (start, _) in self.split.pre_tokenize_str(" ".join(pairs)):
                theirs[start // 3] += 1
            out |= {c for c, pair, count in zip(chars, pairs, theirs) if len(self.found(pair)) != count}
        return "".join(map(regex.escape, sorted(out)))

    def normalized(self, text: str) -> str:
        """As the file's normaliser has it; where that is lower case in composed form, plain ASCII takes a short way."""
        if self.normalizer is None:
            return text
        return text.lower() if self.lowers and text.isascii() else self.normalizer.normalize_str(text)

    def words(self, text: str) -> list[str]:
        if self.plain and not beyond_latin(text):
            return self.plain(text)
        if text.isascii() or not self.beyond(text):
            return self.found(text)
        return [word for word, _ in self.split.pre_tokenize_str(text)]

    def may_hold_special(self, text: str) -> bool:
        return bool(self.special) and self.lead in text

    def word_ids(self, word: str) -> tuple[int, ...]:
        letters, vocab = self.merges.letters, self.merges.vocab
        symbols = list(word) if word.isascii() and word.isprintable() else [letters[b] for b in word.encode()]
        if self.merges.mark:
            symbols[-1] += self.merges.mark
        out: list[int] = []
        push = self.encoder.push
        for symbol in symbols:
            if certain := push(symbol):
                out.extend(map(vocab.__getitem__, certain))
        out.extend(map(vocab.__getitem__, self.encoder.finish()))
        return tuple(out)

    def stream(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of a text, word by word."""
        at = 0
        for cut in self.cut.finditer(text) if self.may_hold_special(text) else ():
            yield from map(self.memory.__getitem__, self.words(self.normalized(text[at : cut.start()])))
            yield (self.special[cut.group()],)
            at = cut.end()
        yield from map(self.memory.__getitem__, self.words(self.normalized(text[at:] if at else text)))

    def encode(self, text: str) -> list[int]:
        if self.may_hold_special(text):
            return list(chain.from_iterable(self.stream(text)))
        return list(chain.from_iterable(map(self.memory.__getitem__, self.words(self.normalized(text)))))

    def decode(self, ids: Iterable[int]) -> str:
        """What the library's decode gives for a file without a decoder: the tokens, parted by blanks."""
        return " ".join(map(self.pieces.__getitem__, ids))

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """The words themselves, as soon as each character is whole; marks become blanks."""
        back = {letter: byte for byte, letter in self.merges.letters.items()}
        special = set(self.special.values())
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        mark = self.merges.mark
        for i in ids:
            piece = self.pieces[i]
            if i in special:
                yield machine.decode(b"", True) + piece
                machine.reset()
                continue
            ended = bool(mark) and piece.endswith(mark)
            body = piece[: -len(mark)] if ended else piece
            yield machine.decode(bytes(back[c] for c in body)) + (" " if ended else "")
        yield machine.decode(b"", True)


def tokenizer_of(content: str) -> Tokenizer:
    return kept(("bpe", sha256(content.encode()).digest()), lambda: Tokenizer(content))


def encoded(docs: DataFrame, path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """All rows with ``tokens`` (array of int) or, for ``digests``, the count and digests of ids and decoded text.

    ``path`` names a tokenizer file, read once by the driver (a megabyte or two) and sent along. A null text has
    no tokens, as an empty one. Any length of text is encoded in whole. Input columns named like a result
    are replaced by it. Nothing is shuffled; an empty table gives an empty result.
    """
    with open(path, encoding="utf-8") as file:
        content = file.read()
    if digests:
        results = ["n_tokens", "ids_sha256", "decoded_sha256"]
        schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        results, schema = ["tokens"], "tokens array<int>"
    packed = docs.select(whole_row(docs).alias("row"), quoted(text).alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # of fixed size: the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(shared.value)
        numbers = tokenizer.numbers
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts, SLICE_BYTES):
                rows = []
                for value in texts.slice(start, stop - start).to_pylist():
                    ids = tokenizer.encode(value) if value else []
                    if digests:
                        joined = " ".join(map(numbers.__getitem__, ids))
                        decoded = tokenizer.decode(ids)
                        rows.append((len(ids), sha256(joined.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()))
                    else:
                        rows.append((ids,))
                kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(start, stop - start), *columns], names=["row", *results]
                )

    return unpacked(packed.mapInArrow(run, f"row {row}, {schema}"), "row", results)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    result = encoded(docs, default_tokenizer(), digests=True)
    return result.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
