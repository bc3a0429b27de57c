"""Texts cut off inside a sentence or word: a backward character n-gram model of ends.

The model reads backward from a place in a text: the last 2 to 24 characters (runs
of digits as one digit) name a context, and two tables count how often a unit ended after
it (the text's end, a blank line, or an end mark with a new sentence) and how often the
unit went on. A text's final context is then weighed end against continuation; what else the
end shows (an end mark, an open formula, a mark of the cut, a token count that does not
fit) is added as further log-odds before the threshold of its language and column.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import CHUNK_CHARS, INVISIBLE, chunks, map_texts, mix64
from tracemill.llm.fillers import holds_nothing, units
from tracemill.llm.language import most, vote
from tracemill.session import materialize

ORDERS = (2, 4, 8, 16, 24)
#: Bounds of the labelled sample the classifier is fitted on: distinct texts, their characters in all, and the characters of one of them.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_LONGEST = 8_000, 12_000_000, 120_000
#: Count from which a longer context is trusted over a shorter one.
TRUST = 4
#: Places where a threshold may lie; scores are counted in steps of a tenth around them.
_GRID = np.linspace(-2.0, 1.0, 31)
_STEPS = len(_GRID) + 9
#: Log-odds of an end where something was put to mark a cut, and where the last stop follows a digit (a number's point may be one).
MARK_ODDS, DIGIT_STOP_ODDS = -1.0, 1.0
#: Log-odds of an end where the last words are the last words of the question, which is whole; and how many words.
ASKED_ODDS, ASKED_WORDS = 12.0, 5
#: Part of its log-odds that a token count adds: counts are of other units or missing in places.
TOKEN_TRUST = 0.25

_CUT_MARK = re.compile(r"(?:\s*(?:[\[(<{]\s*(?:truncated|cut|cut off|cutoff|\.{3}|…|snip|more|continued|output truncated|text truncated|max tokens|length)\s*[\])>}]|\.{3,}+|…++|�++|[​­]++|<\|?(?:end|eos|endoftext|im_end|eot)[^>]*>|\|\.\.\.))+\s*$", re.I)
_TAGS = re.compile(r"</?think>", re.I)
_END_MARKS = "!?。！？।؟"
_CLOSERS = "\"'”’»）)]}*_$」』"
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
_RUN = re.compile(r"[0-9]+|[ \t\n\r\xa0\u2009]+")
#: All that opens or closes; each way begins with a plain character, and a brace behind a backslash is taken with it.
_OPEN_CLOSE = re.compile(r"\$\$?|\{|\}|\\(?:[\[\](){}]|boxed\{)")


def uncut(text: str) -> tuple[str, bool]:
    """The text without what marks a cut at its end, and whether there was such a mark."""
    text = text.rstrip()
    if (last := text[-1:]) < "\x80" and last not in ")]}>" and not text.endswith("..."):
        return text, False  # no mark ends so
    marked, width = False, 60  # most marks are shorter
    while text:
        start = max(0, len(text) - width)
        if text[-1] == ">":  # no mark holds another one
            start = min(start, text.rfind(">", 0, -1) + 1)
        elif text[-1] in ")]}":
            start = min(start, max(0, *(text.rfind(c) for c in "[(<{")))
        m = _CUT_MARK.search(text, start)
        if not m:
            break
        if m.start() == start and start:  # it may begin before
            width = 2 * (len(text) - start)
            continue
        text, marked, width = text[: m.start()].rstrip(), True, 60
    return text, marked


#: What a character is, as bits.
_DIGIT, _BLANK, _LETTER, _SMALL, _STOP, _WIDE, _CLOSER, _CAPITAL = (np.uint8(1 << i) for i in range(8))


class _Tables:
    """Of each character: what it is, its code, and the hash of a code."""

    def __init__(self):
        cp = np.arange(0x110000, dtype=np.int64)
        digit = (cp >= 48) & (cp <= 57)
        blank = (cp == 32) | (cp == 9) | (cp == 10) | (cp == 13) | (cp == 0xA0) | (cp == 0x2009)
        small = (cp >= 97) & (cp <= 122)
        letter = (cp >= 65) & (cp <= 90) | small | (cp >= 0xC0)
        stop, wide, closer = (np.isin(cp, [ord(c) for c in s]) for s in (_END_MARKS + ".", "。！？", _CLOSERS))
        capital = (cp >= 65) & (cp <= 90) | (cp >= 0x400) & (cp <= 0x42F) | (cp >= 0xC0) & (cp <= 0xDE) | (cp >= 0x900)
        self.kind = np.zeros(len(cp), np.uint8)
        for bit, held in zip((_DIGIT, _BLANK, _LETTER, _SMALL, _STOP, _WIDE, _CLOSER, _CAPITAL), (digit, blank, letter, small, stop, wide, closer, capital)):
            self.kind[held] |= bit
        self.code = np.where(digit, 48, np.where(blank, 32, cp)).astype(np.int32)
        self.hash = mix64(cp.astype(np.uint64) + np.uint64(7))


_tables = lru_cache(maxsize=1)(_Tables)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character codes with digit runs as one 0 and blanks as one blank (1 where a blank line was), the texts' borders, and each code's place before."""
    joined = "".join("\x02" + t + "\x03" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _tables().kind[cp]
    same = np.zeros(len(cp), bool)
    same[1:] = kind[1:] & kind[:-1] & (_DIGIT | _BLANK)
    kept = np.flatnonzero(~same)
    letter = kind & _LETTER != 0
    alone = kind & _SMALL != 0
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    code = _tables().code[cp]
    code[alone] = ord("x")  # one name for all variables
    code = code[kept]
    newline = np.searchsorted(kept, np.flatnonzero(cp == 10), "right") - 1
    code[newline[1:][newline[1:] == newline[:-1]]] = 1
    return code, np.flatnonzero(code == 3), kept


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _hasher(code: np.ndarray):
    """A function of places and an order: 64-bit names of the contexts that end there; none reaches back over a blank line."""
    n = len(code)
    border = np.maximum.accumulate(np.where(code <= 2, np.arange(n), 0))
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_tables().hash[code] * up[:-1])])

    def names(place: np.ndarray, k: int) -> np.ndarray:
        start = np.maximum(place + 1 - k, border[place])
        with np.errstate(over="ignore"):
            return mix64((total[place + 1] - total[start]) * down[start] + np.uint64(k))

    return names


def _hashes(code: np.ndarray) -> list[np.ndarray]:
    """The names of the contexts that end with each character, one array per order."""
    names, place = _hasher(code), np.arange(len(code))
    return [names(place, k) for k in ORDERS]


def _is_end(code: np.ndarray) -> np.ndarray:
    """Of each character: whether a unit ends after it."""
    kind = _tables().kind[code]
    stop = kind & _STOP != 0
    done = stop.copy()
    done[1:] |= (kind[1:] & _CLOSER != 0) & stop[:-1]
    out = kind & _WIDE != 0
    out[:-2] |= done[:-2] & (code[1:-1] == 32) & (kind[2:] & _CAPITAL != 0)
    out[:-1] |= (code[1:] == 3) | (code[1:] == 1)
    out[-1:] = True
    return out


def _tally(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different names among ``h``, and how often each ended and was there at all."""
    h = np.sort((h & ~np.uint64(1)) | ends)  # the lowest bit tells an end, so one plain sort orders both
    own = h & ~np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(h) else np.empty(0, np.int64)
    end = np.add.reduceat((h & np.uint64(1)).astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    return own[first], end, np.diff(np.append(first, len(h)))


class EndModel:
    """Counts of ends and continuations by context; thresholds by language and column."""

    def __init__(self):
        self.name: list[np.ndarray] = []
        self.end: list[np.ndarray] = []
        self.on: list[np.ndarray] = []
        self.threshold: dict[tuple[str, str], float] = {}
        self.open_odds = self.stop_odds = 0.0

    def fit(self, texts: list[str]) -> "EndModel":
        names: list[list[np.ndarray]] = [[] for _ in ORDERS]
        kinds: list[np.ndarray] = []
        for a, b in chunks(texts, CHUNK_CHARS):
            code, _, _ = _codes([INVISIBLE.sub("", t.rstrip()) for t in texts[a:b]])
            real = code > 3
            kinds.append(_is_end(code)[real])
            for k, h in enumerate(_hashes(code)):
                names[k].append(h[real])
        ends = np.concatenate(kinds) if kinds else np.empty(0, bool)
        for k in range(len(ORDERS)):
            h = np.concatenate(names[k]) if names[k] else np.empty(0, np.uint64)
            names[k] = []
            name, end, total = _tally(h, ends)
            keep = total > 1  # a context seen once says nothing that a shorter one does not
            self.name.append(name[keep])
            self.end.append(end[keep].astype(np.float32))
            self.on.append((total - end)[keep].astype(np.float32))
        self._fit_signs(texts)
        return self

    def _fit_signs(self, texts: list[str]) -> None:
        """Log-odds of what the last characters do not tell: an open formula or bracket, and a closing end mark.

        Labels come with the texts: a blank line inside a text is an end, a place drawn by hash inside a line is none.
        """
        self.set_signs(_signs(texts))

    def set_signs(self, seen: np.ndarray) -> "EndModel":
        share = (seen[:, 1:] + 1) / (seen[:, :1] + 1)
        odds = np.log(share[1] / share[0])
        self.open_odds, self.stop_odds = float(min(odds[0], 0.0)), float(max(odds[1], 0.0))
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-odds of end against continuation for each text's final context; the longest context seen often enough speaks, its evidence shrunk toward the shorter ones."""
        return self.odds(_final_contexts(texts))

    def odds(self, contexts: np.ndarray) -> np.ndarray:
        odds = np.zeros(len(contexts))
        for k, h in enumerate(contexts.view(np.uint64).T):
            if not len(self.name[k]):
                continue
            s = np.minimum(np.searchsorted(self.name[k], h), len(self.name[k]) - 1)
            known = self.name[k][s] == h
            e, o = self.end[k][s] * known, self.on[k][s] * known
            own = np.log((e + 0.3) / (o + 0.3))
            trust = (e + o) / (e + o + TRUST)
            odds = trust * own + (1 - trust) * odds
        return odds

    def set_thresholds(self, tallies: dict[tuple[str, str], np.ndarray]) -> "EndModel":
        """Per language and column the emptiest place of the scores between ends and cuts; that of the column or of all where fewer than 300 texts speak.

        A tally counts scores in steps of a tenth from 0.5 below the grid on, and at last all scores; tallies add up.
        """
        groups: dict[tuple[str, str], np.ndarray] = {}
        for (lang, c), v in tallies.items():
            for g in {(lang, c), ("", c), ("", "")}:
                groups[g] = groups.get(g, 0) + v
        for g, v in groups.items():
            if v[-1] >= 300:
                near = np.convolve(v[:-1], np.ones(10), "valid")  # scores closer than 0.5
                self.threshold[g] = float(_GRID[(near + np.abs(_GRID + 0.3) * 0.5).argmin()])
        return self

    def limit(self, language: str, column: str) -> float:
        for g in ((language, column), ("", column), ("", "")):
            if g in self.threshold:
                return self.threshold[g]
        return -0.3


def _signs(texts: list[str]) -> np.ndarray:
    """[goes on, ends] by [places, open, closed by an end mark], counted over labelled places of the texts."""
    seen = np.zeros((2, 3), np.int64)
    for t in texts:
        t = t.rstrip()
        draw = zlib.crc32(t.encode("utf-8", "surrogatepass"))
        blank = [m.start() for m in _BLANK_LINE.finditer(t)]
        places = [(1, blank[draw % len(blank)])] if blank else []
        if len(t) > 1:
            places.append((0, 1 + draw % (len(t) - 1)))
        for kind, at in places:
            part = t[:at]
            seen[kind] += (1, _open_delimiters(part), _stops(part)[0])
    return seen


def _open_delimiters(text: str) -> bool:
    """Whether a formula or group is still open at the end."""
    stack: list[str] = []
    for d in _OPEN_CLOSE.findall(text):
        if d in ("\\[", "\\(", "{", "\\boxed{"):
            stack.append(d)
        elif d in ("\\{", "\\}"):
            continue
        elif d in ("$", "$$"):
            if stack and stack[-1] == d:
                stack.pop()
            else:
                stack.append(d)
        elif stack and stack[-1] not in ("$", "$$"):
            stack.pop()
    return bool(stack)


def _last_codes(t: str) -> str:
    """A tail of the text with all the codes that the longest context reaches back over, runs of digits and blanks counted once."""
    n = 96
    while n < len(t) and len(_RUN.sub("0", t[-n:])) < ORDERS[-1] + 8:
        n *= 2
    return t[-n:]


def _stops(text: str) -> tuple[bool, bool]:
    """Whether the text closes with an end mark, and whether with a stop after a digit, which may be a number's point."""
    tail = text.rstrip(_CLOSERS + " ")
    number = tail[-1:] == "." and tail[-2:-1].isdigit()
    return tail[-1:] != "" and tail[-1:] in _END_MARKS + "." and not number, number


@lru_cache(maxsize=64)
def _asked(question: str) -> list[str]:
    return _last_words(question)


def _last_words(t: str) -> list[str]:
    n = 64
    while n < len(t) and len(w := units(t[-n:])) <= ASKED_WORDS:
        n *= 2
    return (units(t) if n >= len(t) else w)[-ASKED_WORDS:]


def end_features(texts: list[str | None], questions: list[str | None] | None = None, told: list[dict[str, float] | None] | None = None) -> list[list]:
    """What the columns of FEATURES say of each text: the names of its final contexts (None where it holds no words, or only a filler), the log-odds of its end that no counts tell, whether it closes with an end mark, whether a formula is open, its language, and its blank-separated words.

    ``told`` may hold the votes of ASCII texts that are known to hold words, as counted without wrappers and fences.
    """
    contexts: list[np.ndarray | None] = [None] * len(texts)
    shift, stops, opened, language, size = [0.0] * len(texts), [False] * len(texts), [False] * len(texts), [""] * len(texts), [0] * len(texts)
    held, bare = [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        size[i] = len(t.split())
        known = told[i] if told else None
        if known is None and holds_nothing(t):
            continue
        b, marked = uncut(_without_tags(t))
        held.append(i)
        bare.append(b)
        # Wrappers are no function words; a mark of the cut or a fence may hold one.
        language[i] = vote(b) if known is None or marked or "```" in b else most(known) if known else ""
        stops[i], number = _stops(b)
        opened[i] = _open_delimiters(b)
        shift[i] = MARK_ODDS * marked + DIGIT_STOP_ODDS * number
        if not stops[i] and questions and questions[i] and len(w := _last_words(b)) == ASKED_WORDS and w == _asked(questions[i]):
            shift[i] += ASKED_ODDS
    for i, c in zip(held, _final_contexts(bare)):
        contexts[i] = c
    return [contexts, shift, stops, opened, language, size]


def _final_contexts(texts: list[str]) -> np.ndarray:
    """Of each text the names of its final contexts, a column per order."""
    if not texts:
        return np.empty((0, len(ORDERS)), np.int64)
    code, borders, _ = _codes([_last_codes(t) for t in texts])
    names = _hasher(code)
    return np.stack([names(borders - 1, k) & ~np.uint64(1) for k in ORDERS], 1).view(np.int64)


def end_odds(model: EndModel, texts: list[str | None], questions: list[str | None] | None = None, told: list[dict[str, float] | None] | None = None) -> tuple[list[float | None], list[float], list[str], list[int]]:
    """Of each text: the model's log-odds that it ends here (None where it holds no words, or only a filler), the further log-odds of its end, its language, and its blank-separated words."""
    contexts, shift, stops, opened, language, size = end_features(texts, questions, told)
    held = [i for i, c in enumerate(contexts) if c is not None]
    odds = model.odds(np.array([contexts[i] for i in held]).reshape(len(held), len(ORDERS)))
    score: list[float | None] = [None] * len(texts)
    for i, x in zip(held, odds):
        score[i] = float(x)
        shift[i] += model.stop_odds * stops[i] + model.open_odds * opened[i]
    return score, shift, language, size


def cut_off(model: EndModel, texts: list[str | None], column: list[str], languages: list[str] | None = None) -> list[bool]:
    """Whether each text breaks off inside a sentence or word; false for null, empty and wordless texts and for fillers."""
    score, shift, language, _ = end_odds(model, texts)
    return [s is not None and s + d < model.limit(lang, c) for s, d, lang, c in zip(score, shift, languages or language, column)]


def _without_tags(t: str) -> str:
    if not t.isascii():
        t = INVISIBLE.sub("", t)
    return _TAGS.sub(" ", t) if "<" in t else t


def sample_model(df: DataFrame, text: str, max_texts: int = SAMPLE_TEXTS, max_chars: int = SAMPLE_CHARS, seed: int = 5) -> EndModel:
    """An end model to be kept, fitted on a bounded sample of the distinct texts; it has no thresholds yet. No query uses it.

    Of the distinct texts of up to SAMPLE_LONGEST characters those with the least hashes
    are drawn, ``max_texts`` and ``max_chars`` at most: hashes and lengths go through one
    narrow aggregation, so copies of a hot text are one row a task, and only the drawn
    texts come to the driver. Labels (a unit ends here, or goes on) come with the texts.
    """
    name = F.xxhash64("t", F.lit(seed)).alias("h")
    rows = df.select(F.col(text).alias("t")).filter(F.length("t").between(1, min(SAMPLE_LONGEST, max_chars)))
    least = rows.select(name, F.length("t").alias("n")).groupBy("h").agg(F.max("n").alias("n")).orderBy("h").limit(max_texts).collect()
    kept = np.flatnonzero(np.cumsum([r.n for r in least]) <= max_chars)
    if not len(kept):
        return EndModel().fit([])
    drawn = rows.filter(F.xxhash64("t", F.lit(seed)) <= least[kept[-1]].h).groupBy(name).agg(F.min("t").alias("t"))
    return EndModel().fit(drawn.orderBy("h").select("t").toArrow().column("t").to_pylist())


def fit_on_sample(df: DataFrame, text: str, column: str, max_texts: int = SAMPLE_TEXTS, max_chars: int = SAMPLE_CHARS, seed: int = 5) -> EndModel:
    """The end model of ``sample_model`` with thresholds from the scores of all rows."""
    model = sample_model(df, text, max_texts, max_chars, seed)
    return model.set_thresholds(tallies(scored_ends(df, text, column, [], model)))


def _named(df: DataFrame, text: str, column: str, keys: list[str], question: str | None) -> DataFrame:
    asked = F.col(question) if question else F.lit(None).cast("string")
    return df.select(*keys, F.col(text).alias("__t"), asked.alias("__q"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("__field"))


SCORED = {"__score": "double", "__shift": "double", "__language": "string", "__words": "int"}


def scored_ends(df: DataFrame, text: str, column: str, keys: list[str], model: EndModel, question: str | None = None) -> DataFrame:
    """keys, ``__field`` and what ``end_odds`` gives for each text; one pass over the texts."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return map_texts(_named(df, text, column, keys, question), lambda texts, questions: list(end_odds(sent.value, texts, questions)), [*keys, "__field"], ["__t", "__q"], SCORED)


FEATURES = {"__contexts": "array<bigint>", "__shift": "double", "__stop": "boolean", "__open": "boolean", "__language": "string", "__words": "int"}
#: Names in a table of counts (odd, as those of contexts are even) for what ``_signs`` counts.
_SIGNS = (1, 3, 5)
#: Bits for each wanted context in the table that tells them, and the most that table has (as a power of two): beyond it more contexts are counted, none is lost.
WANTED_BITS, MOST_BITS = 16, 28
#: Characters whose arrays fit a core's cache, and pairs of codes that a table may have.
CACHED_CHARS, MOST_PAIRS = 100_000, 1 << 20


def _wanted_bits(names: DataFrame) -> np.ndarray:
    """A bit table of the names, as words of 64 bits; its size, a power of two, goes by their number."""
    size = min(MOST_BITS, max(10, int(names.count() * WANTED_BITS).bit_length()))
    place = F.shiftrightunsigned("__name", 64 - size)
    word = names.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__name, {64 - size}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (size - 6), np.uint64)
    table[word.column("word").to_numpy()] = word.column("bits").to_numpy().view(np.uint64)
    return table


def _counted(texts: list[str], wanted: np.ndarray) -> list[np.ndarray]:
    """(name, ends, continuations) of the contexts in the texts that a bit table names, and of the signs.

    A longer context that is wanted has all its shorter ones wanted too, so each order
    looks only at the places that the order before has left. Names are made a few texts at
    a time, whose arrays stay in the cache, and counted for all texts at once.
    """
    shift = np.uint64(64 - 6 - (len(wanted).bit_length() - 1))
    signs = _signs(texts)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ORDERS]

    def told(h: np.ndarray) -> np.ndarray:
        place = (h & ~np.uint64(1)) >> shift
        return (wanted[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    for a, b in chunks(texts, CACHED_CHARS):
        code, _, _ = _codes([INVISIBLE.sub("", t.rstrip()) if not t.isascii() else t.rstrip() for t in texts[a:b]])
        is_end, names = _is_end(code), _hasher(code)
        at = np.flatnonzero(code > 3)
        orders = list(enumerate(ORDERS))
        if (pair := _pairs(code, at)) is not None:  # contexts of two codes are few: they are named and looked up once
            total, end = np.bincount(pair), np.bincount(pair[is_end[at]])
            one = np.zeros(len(total), np.int64)
            one[pair] = at
            held = np.flatnonzero(total)
            h = names(one[held], ORDERS[0])
            kept = told(h)
            end = np.concatenate([end, np.zeros(len(total) - len(end), end.dtype)])
            pairs.append((h[kept] & ~np.uint64(1), end[held[kept]], total[held[kept]]))
            wants = np.zeros(len(total), bool)
            wants[held[kept]] = True
            at = at[wants[pair]]
            del orders[0]
        for i, k in orders:
            h = names(at, k)
            kept = told(h)
            at = at[kept]
            found[i].append((h[kept], is_end[at]))
    out = [(np.array(_SIGNS, np.int64), signs[1], signs[0])]
    out += [(name.view(np.int64), end, total - end) for name, end, total in [_added(pairs)] if len(name)]
    for own in found:
        if own:
            name, end, total = _tally(*(np.concatenate(x) for x in zip(*own)))
            out.append((name.view(np.int64), end, total - end))
    return [np.concatenate(x) for x in zip(*out)]


def _pairs(code: np.ndarray, at: np.ndarray) -> np.ndarray | None:
    """A small number for each place's code and the one before; None where there are too many different codes."""
    seen = np.bincount(code) > 0
    size = int(np.count_nonzero(seen))
    if size * size > MOST_PAIRS:
        return None
    own = (np.cumsum(seen) - 1).astype(np.int32)[code]
    return own[at - 1] * np.int32(size) + own[at]


def _added(counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by name, each name once."""
    if not counts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    name, end, total = (np.concatenate(x) for x in zip(*counts))
    name, place = np.unique(name, return_inverse=True)
    return name, np.bincount(place, end, len(name)).astype(np.int64), np.bincount(place, total, len(name)).astype(np.int64)


def scored_by_all(df: DataFrame, text: str, features: DataFrame) -> DataFrame:
    """The columns of SCORED for a written table with those of FEATURES, by counts over every different text of ``df``.

    Only contexts that some text ends with are counted, told by a bit table; the counts
    are a table of Spark's and are joined by name, so no model of the texts is anywhere in
    one piece. Different texts, of any length, go through one shuffle.
    """
    names = features.select(F.explode("__contexts").alias("__name")).distinct()
    wanted = df.sparkSession.sparkContext.broadcast(_wanted_bits(names))
    texts = df.select(F.col(text).cast("string").alias("__t")).filter("length(__t) > 0").distinct()
    rows = map_texts(texts, lambda x: _counted(x, wanted.value), [], ["__t"], {"__name": "bigint", "__end": "bigint", "__on": "bigint"})
    counts = materialize(rows.groupBy("__name").agg(F.sum("__end").alias("__end"), F.sum("__on").alias("__on")), tidy=True)
    signs = {r["__name"]: (r["__on"], r["__end"]) for r in counts.filter(F.col("__name").isin(*_SIGNS)).collect()}
    model = EndModel().set_signs(np.array([signs.get(k, (0, 0)) for k in _SIGNS]).T)

    final = F.element_at("__contexts", -1)
    each = features.select("__contexts").filter("__contexts is not null").distinct().select(final.alias("__final"), F.posexplode("__contexts").alias("__k", "__name"))
    known = each.join(counts.filter("__end + __on > 1"), "__name", "left")
    count = lambda c, k: F.coalesce(F.max(F.when(F.col("__k") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    wide = known.groupBy("__final").agg(*[count(c, k) for k in range(len(ORDERS)) for c in ("__end", "__on")])
    odds = F.lit(0.0)
    for k in range(len(ORDERS)):
        e, o = F.col(f"__end{k}"), F.col(f"__on{k}")
        trust = (e + o) / (e + o + TRUST)
        odds = trust * F.log((e + 0.3) / (o + 0.3)) + (1 - trust) * odds
    told = wide.select("__final", odds.alias("__score"))
    more = F.when(F.col("__stop"), model.stop_odds).otherwise(0.0) + F.when(F.col("__open"), model.open_odds).otherwise(0.0)
    own = [c for c in features.columns if c not in FEATURES]
    return features.withColumn("__final", final).join(told, "__final", "left").select(*own, "__score", F.when(F.col("__score").isNotNull(), F.col("__shift") + more).otherwise(0.0).alias("__shift"), "__language", "__words")


def tallies(scored: DataFrame) -> dict[tuple[str, str], np.ndarray]:
    """Of each language and field: scores in steps of a tenth, and all of them, counted over all rows by Spark; the driver gets the counts."""
    step = F.least(F.greatest(F.floor((F.col("__score") - float(_GRID[0]) + 0.5) * 10), F.lit(-1)), F.lit(_STEPS)).cast("int")
    out: dict[tuple[str, str], np.ndarray] = {}
    for r in scored.filter("__score is not null").groupBy("__language", "__field", step.alias("step")).agg(F.count("*").alias("n")).collect():
        own = out.setdefault((r["__language"], r["__field"]), np.zeros(_STEPS + 1, np.int64))
        own[-1] += r["n"]
        if 0 <= r["step"] < _STEPS:
            own[r["step"]] += r["n"]
    return out


def decided(scored: DataFrame, model: EndModel, tokens: str | None = None) -> DataFrame:
    """Adds ``cut`` to scored ends (a written table): log-odds below the threshold of language and field.

    Thresholds are set from all rows where the model has none. ``tokens`` names a column
    with the token count that came with the text: against the words that are there it is
    less, the same, more, or absent, and each of the four adds TOKEN_TRUST of its own
    log-odds, told by how often it occurs among the texts that look cut and the others,
    all rows counted.
    """
    if not model.threshold:
        model.set_thresholds(tallies(scored))
    known = F.create_map(*[x for (lang, c), v in {("", "*"): -0.3, **model.threshold}.items() for x in (F.lit(f"{lang}|{c}"), F.lit(v))])
    limit = F.coalesce(known[F.concat_ws("|", "__language", "__field")], known[F.concat(F.lit("|"), "__field")], known["|"], known["|*"])
    odds = F.col("__score") + F.col("__shift")
    if tokens:
        kind = F.when(F.col(tokens) < F.col("__words"), "less").when(F.col(tokens) == F.col("__words"), "same").when(F.col(tokens) > F.col("__words"), "more").otherwise("absent")
        seen = {(r.kind, r.cut): r.n for r in scored.filter("__score is not null").groupBy(kind.alias("kind"), (odds < limit).alias("cut")).agg(F.count("*").alias("n")).collect()}
        total = {c: 4 + sum(n for (_, x), n in seen.items() if x == c) for c in (True, False)}
        weigh = {k: TOKEN_TRUST * float(np.log((seen.get((k, False), 0) + 1) / total[False] * total[True] / (seen.get((k, True), 0) + 1))) for k in ("less", "same", "more", "absent")}
        odds = odds + F.create_map(*[x for k, v in weigh.items() for x in (F.lit(k), F.lit(v))])[kind]
    return scored.withColumn("cut", F.coalesce(odds < limit, F.lit(False)))


def truncated_texts(df: DataFrame, text: str, column: str, keys: list[str], model: EndModel | None = None, tokens: str | None = None, question: str | None = None) -> DataFrame:
    """keys, ``has_text`` and ``cut``: whether each text breaks off inside a sentence or word.

    ``column`` holds the name of the field a text is from; thresholds go by it and by the
    language. ``tokens`` may name a column of token counts (see ``decided``), ``question``
    the text that is answered: a text that ends with its words is as whole as it. Marks put
    after the cut ("...", "[truncated]", a replacement character) are taken off first.
    Null, empty and wordless texts and fillers have no text and are not cut. Repeated rows
    stay. Unless a model is given, contexts are counted over every different text (see
    ``scored_by_all``), and thresholds are set from all scores.
    """
    carried = [*keys, tokens] if tokens and tokens not in keys else keys
    if model:
        scored = scored_ends(df, text, column, carried, model, question)
    else:
        model = EndModel()
        features = map_texts(_named(df, text, column, carried, question), end_features, [*carried, "__field"], ["__t", "__q"], FEATURES)
        scored = scored_by_all(df, text, materialize(features))
    scored = materialize(scored)
    return decided(scored, model, tokens).select(*keys, F.col("__score").isNotNull().alias("has_text"), "cut")
