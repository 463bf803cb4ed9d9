"""Texts that were decoded with the wrong character encoding, and what they said.

A character trigram model with interpolated smoothing is trained on the lines of all documents that show no sign of a
wrong decoding; its counts live in tables of fixed size. Then every word with characters beyond ASCII, or with HTML
entities for them, is put through all encode-decode chains: bytes of UTF-8 read as another encoding, once or twice, and
bytes of one legacy encoding read as another. A chain's score for a line is the sum over its words of the gain in
log-likelihood. The likeliest chain is accepted for a line if its gain exceeds a margin, which is validated on all words of
all clean lines, as they are and garbled on purpose, under models that have not seen those lines.

Replacement characters and their garbled forms mean characters lost for good; those lines are cases with no full
restoration. A garbled sequence that stands alone in quotes or brackets, or alone where its decoded form would make no
sense, is spoken about and not a case, and so is the rest of its line.

Defined cases: NULL, empty and ASCII-only texts without such entities are no cases. Texts are judged whole, line by
line; repeated rows get the same verdict; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.sources.shared import cut

TRIGRAMS, BIGRAMS, CHARS = 1 << 20, 1 << 18, 1 << 16
REMEMBERED = 100_000
MARGINS = np.arange(4.0, 8.5, 0.5)  # what the margin is chosen from
NUMBERS = ("n0", "n1", "n2")
#: (true encoding, the one it is read as) of the words that are garbled on purpose
ON_PURPOSE = (("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1252", "mac-roman"), ("cp1251", "latin-1"), ("cp850", "cp1252"))
LONE = -10.5  # log-likelihood under which a letter or quote between spaces is no word of any language

#: Encodings whose reading of UTF-8 bytes, or of each other's bytes, occurs in practice.
READ_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac-roman", "koi8-r", "iso8859-2", "cp866", "iso8859-15", "cp1254")
MULTIBYTE = ("cp932", "gbk", "euc-jp")
#: (true encoding, the one it was read as)
PAIRS = tuple(
    (true, read) for true in ("cp1251", "koi8-r", "cp866", "mac-cyrillic", "cp437", "cp850", "cp1252", "mac-roman", "cp1250", "iso8859-2", "cp852") for read in ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "cp1250", "iso8859-2", "cp852") if true != read
)
LONG_PAIRS = tuple((true, read) for true in ("cp932", "euc-jp", "gbk") for read in ("cp1252", "latin-1", "mac-roman", "cp437"))

_WORD = re.compile(r"[^ \t\n\r]+")
_ENTITY = re.compile(r"&(?:[A-Za-z]+\d?|#\d+|#x[\da-fA-F]+);")
_BEYOND = r"[^\x00-\x7F]"  # of Java and of Python
_PLAIN = re.compile(r"[\x00-\x7f]+")
_BOX = re.compile(r"[─│┌┐└┘├┤┬┴┼!-/:-@\[-`{-~]*")
_OPEN, _CLOSE = "\"'`“„«‘‚(<[{‹「『", "\"'`”“»’‘)>]}›」』"
_HALF = re.compile("â(?![\x80-\xbf€™œžš“”•–—…„†‡ˆ‰])")
_LOST = re.compile("�|ï¿½|п»ї|Ð¿Ñ—|∩┐╜|´┐¢|ÔøΩ|锟斤拷")


def _charset(encoding: str) -> tuple[dict[int, int], dict[int, str]]:
    """char -> byte and byte -> char beyond ASCII; bytes an encoding leaves undefined stand for themselves, as browsers read them."""
    to_char = {}
    for byte in range(128, 256):
        try:
            to_char[byte] = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            to_char[byte] = chr(byte)
    return {ord(c): b for b, c in to_char.items()}, to_char


_SETS = {name: _charset(name) for name in {*READ_AS, *(x for pair in PAIRS for x in pair), *(read for _, read in LONG_PAIRS)}}


def _utf8_finder(encoding: str, two: tuple[int, int] = (0xC2, 0xDF), three: tuple[int, int] = (0xE0, 0xEF)) -> re.Pattern:
    """Runs of characters whose bytes in the encoding are UTF-8 sequences with leading bytes in the given ranges."""
    chars = _SETS[encoding][1]

    def among(low: int, high: int) -> str:
        return "[" + "".join(re.escape(chars[b]) for b in range(low, high + 1)) + "]"

    more = among(0x80, 0xBF)
    return re.compile(f"(?:{among(*two)}{more}|{among(*three)}{more}{{2}}|{among(0xF0, 0xF4)}{more}{{3}})+")


_FINDERS = {name: _utf8_finder(name) for name in READ_AS}
_LEADING = {name: {_SETS[name][1][b] for b in range(0xC2, 0xF5)} for name in READ_AS}
#: Signs of a wrong decoding, for what is kept from training: letters of Latin, Greek and Cyrillic, punctuation and East
#: Asian text, but not the rest, which quotes before accents of a clean text would suggest.
_ANY_UTF8 = re.compile("|".join(_utf8_finder(x, (0xC2, 0xD1), (0xE2, 0xE9)).pattern for x in ("latin-1", "cp1252", "cp1251", "cp437", "mac-roman", "cp1250")) + "|[\x80-\x84\x86-\x9f]|" + _LOST.pattern)


def suspicious(line: str) -> bool:
    """Whether a line shows a sign of a wrong decoding; the signs consist of characters beyond ASCII only."""
    return not line.isascii() and _ANY_UTF8.search(_PLAIN.sub(" ", line)) is not None


def _read_utf8(word: str, encoding: str) -> str | None:
    if _LEADING[encoding].isdisjoint(word):
        return None
    table = _SETS[encoding][0]

    def fix(match: re.Match) -> str:
        try:
            return bytes(table[ord(c)] for c in match[0]).decode("utf-8")
        except UnicodeDecodeError:
            return match[0]

    out = _FINDERS[encoding].sub(fix, word)
    return out if out != word else None


def _read_multibyte(word: str, encoding: str) -> str | None:
    try:
        out = word.encode(encoding).decode("utf-8")
    except UnicodeError:
        return None
    return out if out != word else None


#: What an encoding spells beyond ASCII
_SPELLED = {name: {chr(c) for c in table} for name, (table, _) in _SETS.items()}
_TRANSLATIONS = {}
for _true, _read in PAIRS:
    _TRANSLATIONS[_true, _read] = {ord(c): _SETS[_true][1][b] for b, c in _SETS[_read][1].items()}


def _read_pair(word: str, true: str, read: str) -> str | None:
    """The word, which the second encoding can spell, as the first one reads it."""
    out = word.translate(_TRANSLATIONS[true, read])
    # single symbols read as single letters prove nothing
    return out if out != word and sum(map(str.isalpha, out)) > 1 else None


def _read_long(word: str, true: str, read: str) -> str | None:
    """The word, which the second encoding can spell, as the first one reads it."""
    table = _SETS[read][0]
    try:
        out = bytes([table[ord(c)] if c > "\x7f" else ord(c) for c in word]).decode(true)
    except UnicodeDecodeError:
        return None
    beyond = sum(c > "\x7f" for c in out)
    return out if out != word and (beyond > 1 or beyond == len(out)) else None


def chains(word: str) -> Iterator[tuple[str, str]]:
    """(name of the chain, decoded word) of every chain that changes the word."""
    if _BOX.fullmatch(word) and "&" not in word:
        return  # the lines of a table or tree
    bases = [("", word)]
    if "&" in word and (plain := _ENTITY.sub(lambda m: html.unescape(m[0]), word)) != word:
        bases.append(("html>", plain))
    for prefix, base in bases:
        for name in READ_AS:
            once = _read_utf8(base, name)
            if once is None:
                continue
            yield f"{prefix}utf-8 as {name}", once
            for again in READ_AS:
                twice = _read_utf8(once, again)
                if twice is not None:
                    yield f"{prefix}utf-8 as {again}, then as {name}", twice
                    for first in READ_AS:
                        third = _read_utf8(twice, first)
                        if third is not None:
                            yield f"{prefix}utf-8 as {first}, then as {again}, then as {name}", third
        if base.isascii():
            continue
        if "â" in base and not base.isupper():  # the controls after it were dropped
            for mark in "’“”–—…→":
                if (out := _HALF.sub(mark, base)) != base:
                    yield f"{prefix}utf-8 as latin-1, controls lost ({mark})", out
        for name in MULTIBYTE:
            if (out := _read_multibyte(base, name)) is not None:
                yield f"{prefix}utf-8 as {name}", out
        beyond = {c for c in base if c > "\x7f"}
        spelled = {read for read in _SPELLED if beyond <= _SPELLED[read]}
        for true, read in PAIRS:
            if read in spelled and (out := _read_pair(base, true, read)) is not None:
                yield f"{prefix}{true} as {read}", out
        for true, read in LONG_PAIRS:
            if read in spelled and (out := _read_long(base, true, read)) is not None:
                yield f"{prefix}{true} as {read}", out


def apply_chain(word: str, chain: str) -> str:
    """The word as the chain reads it, or as it is where the chain doesn't apply."""
    return next((out for name, out in chains(word) if name == chain), word)


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    digits = (codes >= 48) & (codes <= 57)
    codes[digits] = 48
    return codes


def _slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    two = (b * 1_000_003 + c * 7_919) % BIGRAMS
    three = (a * 2_654_435_761 + b * 1_000_003 + c * 7_919) % TRIGRAMS
    return three.astype(np.int64), two.astype(np.int64), (c % CHARS).astype(np.int64)


class Model:
    """Character trigrams with interpolated smoothing over count tables of fixed size."""

    def __init__(self, three: np.ndarray, two: np.ndarray, one: np.ndarray) -> None:
        self.three, self.two, self.one, self.total = three, two, one, max(1, int(one.sum()))
        self.known: dict[str, float] = {}

    def _gram(self, gram: str) -> float:
        a, b, c = (48 if "0" <= char <= "9" else ord(char) for char in gram)  # the slots are those of _slots
        two, before = (b * 1_000_003 + c * 7_919) % BIGRAMS, (a * 1_000_003 + b * 7_919) % BIGRAMS
        three = (a * 2_654_435_761 + b * 1_000_003 + c * 7_919) % TRIGRAMS
        p = 0.1 * (self.one[c % CHARS] + 0.05) / (self.total + 0.05 * CHARS)
        if n := self.one[b % CHARS]:
            p += 0.2 * min(1.0, self.two[two] / n)
        if n := self.two[before]:
            p += 0.7 * min(1.0, self.three[three] / n)
        out = math.log(p)
        if len(self.known) < REMEMBERED * 5:
            self.known[gram] = out
        return out

    def score(self, word: str) -> float:
        """Log-likelihood of the word between spaces."""
        text, known, gram = f"  {word} ", self.known, self._gram
        return sum([known.get(text[i : i + 3]) or gram(text[i : i + 3]) for i in range(len(text) - 2)])


def counts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of all clean lines, as three tables of fixed size for each of two halves of the documents, told by their key."""
    sizes = (TRIGRAMS, BIGRAMS, CHARS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        halves = [[np.zeros(n, np.int64) for n in sizes] for _ in range(2)]
        for batch in batches:
            for half, tables in enumerate(halves):
                clean = []
                for t in batch["t"][batch["half"] == half]:
                    if t:
                        clean += [line for line in t.split("\n") if line and not suspicious(line)]
                for at in range(0, len(clean), 5_000):
                    # two spaces begin each word and one ends it, as in Model.score
                    slots = _slots(_codes("  " + " \n  ".join(clean[at : at + 5_000]).replace(" ", "  ") + " "))
                    for table, index in zip(tables, slots):
                        table += np.bincount(index, minlength=len(table))
        for i, (one, two) in enumerate(zip(*halves)):
            at = np.flatnonzero(one + two)
            yield pd.DataFrame({"i": np.full(len(at), i, np.int32), "at": at, "n0": one[at], "n1": two[at]})

    summed = documents.select(_half(key).alias("half"), F.col(text).alias("t")).mapInPandas(count, "i int, at int, n0 long, n1 long").groupBy("i", "at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    out = [[np.zeros(n, np.int64) for n in sizes] for _ in range(2)]
    rows = summed.toPandas()  # at most one row per slot of the fixed tables
    for i, group in rows.groupby("i"):
        for half in range(2):
            out[half][i][group["at"].to_numpy()] = group[f"n{half}"].to_numpy()
    return [tuple(x) for x in out]


def _half(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(2)).cast("int")


class Judge:
    def __init__(self, model: Model, margin: float) -> None:
        self.model, self.margin = model, margin  # the margin may be set anew at any time
        self.words: dict[str, list[tuple[str, float, str]]] = {}

    def _gains(self, word: str) -> Iterator[tuple[str, float, str]]:
        """(chain, gain, decoded) of all chains."""
        now = plain = self.model.score(word)
        if "&" in word:  # entities by themselves are no garbling: what they stand for is what a chain has to beat
            plain = max(now, self.model.score(_ENTITY.sub(lambda m: html.unescape(m[0]), word)))
        scores: dict[str, float] = {}  # many chains read the same
        for name, new in chains(word):
            if (score := scores.get(new)) is None:
                score = scores[new] = self.model.score(new)
            yield name, score - (plain if name.startswith("html>") else now), new

    def candidates(self, word: str) -> list[tuple[str, float, str]]:
        """(chain, gain, decoded) of the chains that make the word likelier."""
        out = self.words.get(word)
        if out is None:
            best = {name: (gain, new) for name, gain, new in self._gains(word) if gain > 0}
            out = [(name, gain, new) for name, (gain, new) in best.items()]
            if len(self.words) < REMEMBERED:
                self.words[word] = out
        return out

    def gain(self, word: str, enough: float = math.inf) -> float:
        """The gain of the word's likeliest chain, or of the first that gains enough."""
        most = 0.0
        for _, gain, _ in self._gains(word):
            most = max(most, gain)
            if most >= enough:
                break
        return most

    def _mentioned(self, word: str, new: str) -> bool:
        """The garbled sequence stands alone: enclosed, or where its decoded form is unlikely."""
        core = word.rstrip(",.;:!?")
        inner = core.strip(_OPEN + _CLOSE)
        if any(c.isascii() and c.isalnum() for c in inner):
            return False
        decoded = new.rstrip(",.;:!?")
        shown = decoded.strip(_OPEN + _CLOSE) or decoded
        if len(shown) > 1:
            return False
        if len(core) > 2 and core[0] in _OPEN and core[-1] in _CLOSE and decoded[:1] == core[0] and decoded[-1:] == core[-1]:
            return True
        return (shown.isalpha() or shown in "’‘“”‚„") and self.model.score(decoded) < LONE

    def _lone(self, word: str, chain: str) -> str:
        """A word of a line that is garbled by a chain: single letters prove nothing by themselves, but are read the same way."""
        pair = tuple(chain.split(" as "))
        if pair not in _TRANSLATIONS or word.isascii() or any(ord(c) > 127 and ord(c) not in _TRANSLATIONS[pair] for c in word):
            return word
        out = word.translate(_TRANSLATIONS[pair])
        return out if self.model.score(out) > self.model.score(word) else word

    def line(self, line: str) -> tuple[str, str] | None:
        """(chain, restored line) of a garbled line; the chain is lost where characters are lost for good."""
        if line.isascii() and ("&" not in line or not _ENTITY.search(line)):
            return None
        lost = [m for m in _LOST.finditer(line) if not (line[m.start() - 1 : m.start()] in _OPEN and line[m.end() : m.end() + 1] in _CLOSE and m.start() and m.end() < len(line))]
        gains: dict[str, float] = {}
        found: list[tuple[str, list[tuple[str, float, str]]]] = []
        mentioned = plain = False
        for word in _WORD.findall(line):
            if word.isascii() and "&" not in word:
                continue
            candidates = self.candidates(word)
            if candidates:
                name, gain, new = max(candidates, key=lambda c: c[1])
                if name.startswith("utf-8"):
                    mentioned |= self._mentioned(word, new)
                    plain |= gain > self.margin and any(c.isascii() and c.isalnum() for c in word)
                found.append((word, candidates))
            for name, gain, new in candidates:
                gains[name] = gains.get(name, 0.0) + gain
        if gains and not (mentioned and not plain):
            name = max(gains, key=gains.__getitem__)  # of equal chains the first, which is the commonest
            if gains[name] >= self.margin:
                words = {word: new for word, candidates in found for chain, _, new in candidates if chain == name}
                return name, _WORD.sub(lambda m: words.get(m[0]) or self._lone(m[0], name), line)
        return ("lost", line) if lost else None

    def text(self, text: str | None) -> tuple[str | None, str | None]:
        """(chains, restored text) of a garbled text, (None, None) else."""
        if not text or text.isascii() and ("&" not in text or not _ENTITY.search(text)):
            return None, None
        names, out = set(), []
        for line in text.split("\n"):
            verdict = self.line(line)
            if verdict:
                names.add(verdict[0])
                line = verdict[1]
            out.append(line)
        return ("; ".join(sorted(names)), "\n".join(out)) if names else (None, None)


def _whole(halves: Broadcast) -> Model:
    return Model(*(a + b for a, b in zip(*halves.value)))


def judged(documents: DataFrame, halves: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All that one pass over the texts under the model of both halves tells, in rows of two kinds.

    (w, n0, n1, n2): words with characters beyond ASCII or entities, with their numbers in the clean lines of each half that
    the counts are from, and in the clean lines that the counts left out for a sign of a wrong decoding. Lines that even
    the highest margin accepts as garbled are not clean: they are cases whatever the margin.

    (least, most, k, chain, restored): garbled rows by their key, as they are restored by the margins from least to most.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(_whole(halves), MARGINS[-1])
        found = [Counter() for _ in NUMBERS]

        def rows(n: int, **columns: object) -> pd.DataFrame:
            return pd.DataFrame({c: columns.get(c, pd.Series([None] * n, dtype=object)) for c in ("w", *NUMBERS, "least", "most", "k", "chain", "restored")})

        def words() -> pd.DataFrame:
            every = list(set().union(*found))
            return rows(len(every), w=pd.Series(every, dtype=object), **{n: np.array([each[w] for w in every], np.int64) for n, each in zip(NUMBERS, found)})

        for batch in batches:
            cases = []
            for at, (half, t) in enumerate(zip(batch["half"], batch["t"])):
                garbled = False
                for line in t.split("\n"):
                    if line.isascii() and "&" not in line:
                        continue
                    judge.margin = MARGINS[0]
                    if judge.line(line):  # else no margin accepts it
                        garbled = True
                        judge.margin = MARGINS[-1]
                        if judge.line(line):
                            continue
                    found[2 if suspicious(line) else half].update(w for w in _WORD.findall(line) if not w.isascii() or "&" in w and _ENTITY.search(w))
                if garbled:
                    cases += [(at, *case) for case in _by_margin(judge, t)]
            if cases:
                at, least, most, chain, restored = zip(*cases)
                yield rows(len(at), least=least, most=most, k=batch["k"].take(at).reset_index(drop=True), chain=chain, restored=restored)
            if sum(map(len, found)) > REMEMBERED:
                yield words()
                found = [Counter() for _ in NUMBERS]
        yield words()

    tried = documents.where(F.col(text).rlike(f"{_BEYOND}|{_ENTITY.pattern}"))  # what has neither never leaves the scan
    return tried.select(_half(key).alias("half"), F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"w string, n0 long, n1 long, n2 long, least double, most double, k {kind}, chain string, restored string")


def _by_margin(judge: Judge, text: str) -> list[tuple[float, float, str, str]]:
    """(least, most, chains, restored) of a text for all margins that accept it; a higher one accepts no line that a lower one doesn't."""

    def verdict(margin: float) -> tuple[str | None, str | None]:
        judge.margin = margin
        return judge.text(text)

    if (same := verdict(MARGINS[0])) == verdict(MARGINS[-1]):
        return [(MARGINS[0], MARGINS[-1], *same)]
    return [(margin, margin, *found) for margin in MARGINS if (found := verdict(margin))[0] is not None]


def clean_words(passed: DataFrame) -> DataFrame:
    """(w, n0, n1, n2) of the words of what ``judged`` gives, each once."""
    counted = passed.where(F.col("w").isNotNull()).select("w", *NUMBERS)
    # few bytes, much work: as many partitions as the session has for shuffles, whatever the size
    spread = counted.repartition(int(passed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "w")
    return spread.groupBy("w").agg(*(F.sum(n).alias(n) for n in NUMBERS))


def errors_of(words: DataFrame, halves: Broadcast) -> DataFrame:
    """(margin, taken, clean, missed, garbled) of every margin: clean words by their numbers, and those of them that would
    be taken for garbled; words garbled on purpose, and those of them that would be missed. Each word is judged by a model
    that has not seen its lines: that of the other half, or that of both for lines that the counts left out."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judges = [Judge(model, 0.0) for model in (Model(*halves.value[1]), Model(*halves.value[0]), _whole(halves))]
        taken, missed = np.zeros(len(MARGINS), np.int64), np.zeros(len(MARGINS), np.int64)
        clean = garbled = 0
        for batch in batches:
            for word, *numbers in zip(batch["w"], *(batch[n] for n in NUMBERS)):
                forms = [] if word.isascii() else _garbled_on_purpose(word)
                for each, n in zip(judges, numbers):
                    if n:
                        taken += n * (each.gain(word, MARGINS[-1]) >= MARGINS)
                        clean += n
                        for form in forms:
                            missed += each.gain(form, MARGINS[-1]) < MARGINS
                        garbled += len(forms)
        yield pd.DataFrame({"margin": MARGINS, "taken": taken, "clean": clean, "missed": missed, "garbled": garbled})

    sums = words.mapInPandas(judge, "margin double, taken long, clean long, missed long, garbled long").groupBy("margin")
    return sums.agg(*(F.sum(c).alias(c) for c in ("taken", "clean", "missed", "garbled")))


def _garbled_on_purpose(word: str) -> list[str]:
    out = []
    for true, read in ON_PURPOSE:
        try:
            out.append("".join(_SETS[read][1][b] if b > 127 else chr(b) for b in word.encode(true)))
        except UnicodeEncodeError:
            continue
    return out


def margin_of(words: DataFrame, halves: Broadcast) -> float:
    """The margin, at least 4, that best separates clean words, by their counts, from the same words garbled on purpose."""
    errors = errors_of(words, halves).orderBy("margin").collect()  # a row per margin
    if not any(r["garbled"] for r in errors):
        return float(MARGINS[0])
    # a clean word taken for a garbled one costs more than a garbled one missed, because clean words are far more
    return min(errors, key=lambda r: 5 * r["taken"] / r["clean"] + r["missed"] / r["garbled"])["margin"]


def restore(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chain, restored) of the garbled rows."""
    spark = documents.sparkSession
    halves = spark.sparkContext.broadcast(counts(documents, key, text))  # fixed size
    passed = cut(judged(documents, halves, key, text), "garbled")
    margin = margin_of(clean_words(passed), halves)
    return passed.where(F.lit(margin).between(F.col("least"), F.col("most"))).select(F.col("k").alias(key), "chain", "restored")
