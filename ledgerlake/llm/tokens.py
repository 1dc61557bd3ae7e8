"""Exact token counts by dynamic programming over prefixes.

For every prefix of every text, sign by sign, the exact number of tokens of that prefix (taken as a
text of its own) is computed once and stored. Counts, truncation and budgets are then look-ups; no
text is encoded again.

1. White space is dropped by the tokenizer and never joined across, and so are the ends of its own
   splits (a run of letters, one number, a run of other signs, a contraction), so what stands before
   a split adds a fixed count: ``count[k] = count[start of the split] + inside[k]``.
2. Inside a split the program runs over its bytes. Any run of neighbouring tokens of an encoding is
   itself an encoding, and a row of tokens is one when every two neighbours are. So the encoding of
   a prefix is that of a shorter prefix plus one last token which agrees with the token before it:
   ``open[i] = open[j] + 1`` for the one token from j to i that agrees. A prefix that ends a text
   ends with a token that marks the end of a word, which is looked up from ``open`` in the same way.
3. The table has one row per document: the count after every ``BLOCK`` signs and at the end
   (``marks``), and the difference from each prefix to the next (``steps``), a byte a sign.

Each different word is worked out once per task. A special string counts as one token where it is
whole and as plain text where a prefix cuts it, as the library does by default.

Words that Unicode composition changes (decomposed accents) are the one exception in step 2: there
the library counts each prefix of a stretch between safe cuts while the table is built, which takes
the square of that stretch's length. All other work is linear in the text.

Defined cases: null and empty texts have 0 tokens and an empty table; texts of any length are
counted whole; rows are counted one by one, so repeated rows and null or shared doc_ids are counted
alike; further columns are not read; an empty table gives an empty result.
"""

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from math import inf
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.words import SPACES, WORD, byte_slices
from ledgerlake.sources.scratch import stored

LIMIT = 2048
VOCABULARY = "word_bpe_49k.json"
#: Signs between two stored counts.
BLOCK = 256
#: Words longer than this many signs are worked out again when met again.
KEPT_LENGTH = 64
#: Distinct words remembered per task (the last ones and as many before them), pairs of tokens, and states of the
#: program, which are shared up to this many byte signs of a split (at most 255: their counts are kept as bytes).
KEPT_WORDS, KEPT_PAIRS, KEPT_STATES, KEPT_PREFIX = 600_000, 300_000, 800_000, 24

#: Last signs by which the longest token that can end there is known.
ENDING = 3
#: The state of the empty prefix: last token, count, and the counts of all prefixes.
EMPTY = ("", 0, b"")

# The contractions that the vocabulary's splits keep whole, and its mark of a word's end.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WORD_END = "</w>"

BLANK = "\x20\t\n\x0b\x0c\r"
#: A word with the blank behind it, or a run of white space.
_PARTS = re.compile(rf"{WORD}\x20?|{SPACES}")
#: Where a word may be cut although composition changes it: left and right are encoded alike on their own.
_SAFE = re.compile(r"(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])")

LETTER, NUMBER, OTHER, SPACE = "LNOS"
_SPLITS = re.compile("L+|N|O+|S+")


class _Learned(dict):
    """What a function says of each sign, asked once."""

    def __init__(self, ask: Callable[[str], str]):
        self.ask = ask

    def __missing__(self, sign: str) -> str:
        found = self[sign] = self.ask(sign)
        return found


class PrefixCounter:
    """Counts the tokens of every prefix for one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or model.get("ignore_merges"):
            raise ValueError(f"{path}: a BPE vocabulary that marks the ends of words is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(left, right): rank for rank, (left, right) in enumerate(merges)}
        formed = {left + right: rank for (left, right), rank in reversed(self.ranks.items())}
        if any(max(formed.get(p, -1) for p in pair) >= rank for pair, rank in self.ranks.items()):
            raise ValueError(f"{path}: every merge must come after those of its parts")
        self.inner = {t for t in model["vocab"] if not t.endswith(WORD_END)}
        self.final = {t.removesuffix(WORD_END): t for t in model["vocab"] if t.endswith(WORD_END)}
        self.either = self.inner | self.final.keys()
        self.longest = max(map(len, self.either))
        self.far: dict[str, int] = {}  # the longest token by its last signs
        for token in sorted(self.either, key=len):
            if len(token) >= ENDING:
                self.far[token[-ENDING:]] = len(token)
        special = sorted((t["content"] for t in described["added_tokens"]), key=len, reverse=True)
        self.other_special = any("<" not in t for t in special)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kinds, self.bytes = _Learned(self.kind), _Learned(lambda sign: self.described(sign)[0][2])
        self.states: dict[str, tuple[str, int, bytes]] = {"": EMPTY}
        nothing = [("", inf)]
        self.edges: dict[str, tuple[list[tuple[str, float]], list[tuple[str, float]]]] = {"": (nothing, nothing)}
        self.signs: dict[str, list[tuple[str, str, str]]] = {}

    # ---- one split

    def grown(self, token: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """How a token grows at its right and at its left edge: each part there, with the rank that ends it."""
        parts = list(token.removesuffix(WORD_END))
        if token.endswith(WORD_END):
            parts[-1] += WORD_END
        right, left = [], []
        while len(parts) > 1:
            ranks = [self.ranks.get(pair, inf) for pair in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == inf:
                break
            at = ranks.index(least)
            if at == len(parts) - 2:
                right.append((parts[-1], least))
            if at == 0:
                left.append((parts[0], least))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        whole = parts == [token]
        found = self.edges[token] = ([*right, (token, inf)], [*left, (token, inf)]) if whole else ([], [])
        return found

    def agree(self, left: str, right: str) -> bool:
        """What :meth:`agreed` says, remembered in ``pairs``."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        found = self.pairs[left, right] = self.agreed(left, right)
        return found

    def agreed(self, left: str, right: str) -> bool:
        """Do these two tokens stay as they are when encoded together? ``left`` may be empty.

        They do unless, at some rank, the parts at their meeting edges would rather join each other.
        """
        ends, begins = self.edges.get(left) or self.grown(left), self.edges.get(right) or self.grown(right)
        ends, begins = ends[0], begins[1]
        if not begins or not ends:  # a token that its own signs do not give
            return False
        a = b = 0
        ranks = self.ranks
        while True:
            x, ends_x = ends[a]
            y, ends_y = begins[b]
            joins = ranks.get((x, y), inf)
            if joins < ends_x and joins <= ends_y:
                return False
            if ends_x <= ends_y:
                if ends_x == inf:
                    return True
                a += 1
            else:
                b += 1

    def state(self, split: str, i: int, before: Callable[[int], tuple]) -> tuple[str, int, int]:
        """Last token and count of the open prefix of ``i`` signs, and the count of that prefix as a whole text.

        ``before`` gives the states of shorter prefixes, last token and count first.
        """
        token, count, closed = "", 0, 0
        either, inner, final, pairs = self.either, self.inner, self.final, self.pairs
        far = self.far.get(split[i - ENDING : i], ENDING - 1) if i > ENDING else i
        for j in range(max(0, i - far), i):
            piece = split[j:i]
            if piece in either:
                last, sofar, _ = before(j)
                if not token and piece in inner:
                    agree = pairs.get((last, piece))
                    if agree if agree is not None else self.agree(last, piece):
                        token, count = piece, sofar + 1
                        if closed:
                            break
                if not closed and piece in final:
                    ending = final[piece]
                    agree = pairs.get((last, ending))
                    if agree if agree is not None else self.agree(last, ending):
                        closed = sofar + 1
                        if token:
                            break
        return token, count, closed

    def begun(self, begin: str) -> tuple[str, int, bytes]:
        """Last token and count of a split of at most ``KEPT_PREFIX`` signs, and the tokens of its prefixes.

        Splits that begin alike share the states of their common prefixes: of every split in ``states``
        all prefixes are there too, so only what follows the longest of them is worked out.
        """
        known = self.states
        found = known.get(begin)
        if found is None:
            if len(known) >= KEPT_STATES:
                known.clear()
                known[""] = EMPTY
            at = len(begin) - 1
            while begin[:at] not in known:
                at -= 1
            found, before = known[begin[:at]], lambda j: known[begin[:j]]
            for i in range(at + 1, len(begin) + 1):
                token, count, closed = self.state(begin, i, before)
                found = known[begin[:i]] = (token, count, found[2] + closed.to_bytes())
        return found

    def inside(self, split: str) -> list[int]:
        """Tokens of every prefix of one split (in the vocabulary's byte signs), each taken as a whole text."""
        if len(split) <= KEPT_PREFIX:
            return list(self.begun(split)[2])
        begin = split[:KEPT_PREFIX]
        counts = list(self.begun(begin)[2])
        walked, start = [self.states[begin[:i]] for i in range(KEPT_PREFIX + 1)], 0
        for i in range(len(walked), len(split) + 1):
            state = self.state(split, i, lambda j: walked[j - start])
            walked.append(state)
            counts.append(state[2])
            if len(walked) > 8192:  # only the last few states are read again
                start += len(walked) - self.longest
                del walked[: -self.longest]
        return counts

    # ---- one word

    def described(self, sign: str) -> list[tuple[str, str, str]]:
        """A sign as the library sees it: normalised signs, the kind of each, and its byte signs."""
        found = self.signs.get(sign)
        if found is None:
            found = self.signs[sign] = []
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for s in self.tokenizer.normalizer.normalize_str(sign):
                alone = cut(s)
                if not alone:
                    kind = SPACE
                elif len(cut("a" + s)) == 1:
                    kind = LETTER
                else:
                    kind = NUMBER if len(cut(s + s)) == 2 else OTHER
                found.append((s, kind, alone[0][0] if alone else ""))
        return found

    def kind(self, sign: str) -> str:
        """The kind of a sign that the library keeps as one sign; a question mark for others and apostrophes."""
        seen = self.described(sign)
        return seen[0][1] if len(seen) == 1 and sign != "'" else "?"

    def plain(self, word: str) -> list[int]:
        """Tokens of every prefix of a composed word without special strings."""
        kinds = "".join(map(self.kinds.__getitem__, word))
        if "?" in kinds:
            return self.uneven(word)
        counts, before = [], 0
        for m in _SPLITS.finditer(kinds):
            run = word[m.start() : m.end()]
            if m.group()[0] == SPACE:
                counts += [before] * len(run)
                continue
            if run.isascii():
                inside = self.inside(run.lower())
            else:
                parts = list(map(self.bytes.__getitem__, run))
                every = self.inside("".join(parts))
                inside = [every[end - 1] for end in accumulate(map(len, parts))]
            counts += [before + c for c in inside] if before else inside
            before = counts[-1]
        return counts

    def uneven(self, word: str) -> list[int]:
        """The same for a word with contractions, or with signs that become several."""
        signs = [self.described(s) for s in word]
        flat = [s for sign in signs for s in sign]
        counts, before, at = [], 0, 0
        while at < len(flat):
            sign, kind, _ = flat[at]
            if kind == SPACE:
                counts.append(before)
                at += 1
                continue
            whole = ""
            if sign == "'":
                ahead = "".join(s for s, _, _ in flat[at : at + 3])
                whole = next((c for c in CONTRACTIONS if ahead.startswith(c)), "")
            end = at + 1
            if whole:
                end = at + len(whole)
            elif kind != NUMBER:
                while end < len(flat) and flat[end][1] == kind:
                    end += 1
            parts = [b for _, _, b in flat[at:end]]
            inside = self.inside("".join(parts))
            if whole:  # cut short, it is an apostrophe and letters
                apostrophe = self.inside(parts[0])[-1]
                counts.append(before + apostrophe)
                rest = self.inside("".join(parts[1:-1]))
                counts.extend(before + apostrophe + c for c in rest)
                counts.append(before + inside[-1])
            else:
                place = -1
                for part in parts:
                    place += len(part)
                    counts.append(before + inside[place])
            before += inside[-1]
            at = end
        if len(flat) == len(word) and all(signs):
            return counts
        out, at = [], 0
        for sign in signs:
            at += len(sign)
            out.append(counts[at - 1] if at else 0)
        return out

    def composed(self, word: str) -> list[int]:
        """Tokens of every prefix of a word whose signs compose, counted by the library between safe cuts."""
        counts, before = [], 0
        edges = [*dict.fromkeys([0, *(m.start() for m in _SAFE.finditer(word)), len(word)])]
        for start, end in zip(edges, edges[1:], strict=False):
            if unicodedata.is_normalized("NFC", word[start:end]):
                counts.extend(before + c for c in self.plain(word[start:end]))
            else:
                for at in range(start + 1, end + 1, 256):
                    prefixes = [word[start:k] for k in range(at, min(at + 256, end + 1))]
                    found = self.tokenizer.encode_batch_fast(prefixes, add_special_tokens=False)
                    counts.extend(before + len(e.ids) for e in found)
            before = counts[-1]
        return counts

    def ordinary(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return self.inside(word.lower())
        return self.plain(word) if unicodedata.is_normalized("NFC", word) else self.composed(word)

    def prefixes(self, word: str) -> list[int]:
        """Tokens of every prefix of a word, from one sign to all."""
        if "<" not in word and not self.other_special:
            return self.ordinary(word)
        counts, before, start = [], 0, 0
        for m in self.special.finditer(word):
            # all but its last sign is plain text that goes on from what stands before it
            cut = self.ordinary(word[start : m.end() - 1])
            counts.extend(before + c for c in cut)
            before += (cut[m.start() - start - 1] if m.start() > start else 0) + 1
            counts.append(before)
            start = m.end()
        if start < len(word):
            counts.extend(before + c for c in self.ordinary(word[start:]))
        return counts

    # ---- whole texts

    def steps(self, part: str) -> bytes:
        """The difference that each sign of a word, and of white space around it, makes to the count."""
        word = part.strip(BLANK)
        counts = self.prefixes(word) if word else []
        return array("i", map(sub, counts, [0, *counts])).tobytes() + bytes(4 * (len(part) - len(word)))

    def __call__(self, text: str) -> np.ndarray:
        """The difference that each sign of a text makes to the count of its prefix."""
        known, parts = self.known, _PARTS.findall(text)
        steps = list(map(known.get, parts))
        for at, found in enumerate(steps):
            if found is None:
                part = parts[at]
                found = steps[at] = known.get(part) or self.older.get(part) or self.steps(part)
                if len(part) <= KEPT_LENGTH:
                    if len(known) >= KEPT_WORDS:
                        self.older, self.known = known, {}
                        known = self.known
                    known[part] = found
        return np.frombuffer(b"".join(steps), np.int32)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(steps: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The stored form of a text's steps: counts after every block and at the end, and the steps as bytes."""
    if not len(steps):
        return np.zeros(1, np.int64), b""
    marks = np.cumsum(np.add.reduceat(steps, np.arange(0, len(steps), BLOCK)), dtype=np.int64)
    narrow = steps.min() >= -128 and steps.max() <= 127
    return marks, steps.astype(np.int8).tobytes() if narrow else steps.tobytes()


def unpacked(signs: int, steps: bytes) -> np.ndarray:
    return np.frombuffer(steps, np.int8 if len(steps) == signs else np.int32)


def prefix_at(row: dict, signs: int) -> int:
    """Exact number of tokens of a text's first ``signs`` signs, from its row of the table."""
    signs = min(signs, row["n_signs"])
    block = signs // BLOCK
    before = row["marks"][block - 1] if block else 0
    return int(before + unpacked(row["n_signs"], row["steps"])[block * BLOCK : signs].sum(dtype=np.int64))


def cut_at(row: dict, budget: int) -> int:
    """Most signs of a text whose prefix has at most ``budget`` tokens, from its row of the table."""
    counts = np.cumsum(unpacked(row["n_signs"], row["steps"]), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_tables(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_signs and the counts of all prefixes (``marks``, ``steps``) of every text."""
    path = path or vocabulary()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in byte_slices(batch, "text", limit=2**21, rows=512):
                rows = [packed(steps) for steps in map(count, (t or "" for t in part.column("text").to_pylist()))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "n_bytes", "n_signs")),
                        pa.array([m for m, _ in rows], pa.list_(pa.int64())),
                        pa.array([s for _, s in rows], pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_signs", "marks", "steps"],
                )

    sized = documents.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_signs"),
        "text",
    )
    doc_id = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, n_bytes long, n_signs long, marks array<long>, steps binary"
    return sized.mapInArrow(build, schema)


def budgeted(tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """What a table of prefixes says of a budget: n_tokens, over_limit, and the signs that fit (``fit_signs``).

    The whole count is the table's last mark. Steps are read only for texts beyond the budget.
    """
    n_tokens = F.element_at("marks", -1)
    asked = tables.select(
        "doc_id",
        "n_bytes",
        "n_signs",
        n_tokens.alias("n_tokens"),
        (n_tokens > limit).alias("over_limit"),
        F.when(n_tokens > limit, F.col("steps")).alias("steps"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("n_signs").to_pylist(), batch.column("steps").to_pylist(), strict=True)
            fits = [n if s is None else cut_at({"n_signs": n, "steps": s}, limit) for n, s in rows]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fits, pa.int64())], [*names, "fit_signs"])

    doc_id = tables.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, n_bytes long, n_tokens long, over_limit boolean, fit_signs long"
    return asked.mapInArrow(cut, schema)


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_signs of every text, read from its stored prefixes."""
    return budgeted(stored(prefix_tables(documents, path), "token-prefixes"), limit)
