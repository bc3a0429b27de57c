"""Sentence units in many scripts by a finite transducer, run as composed state functions.

Every character gets a class (a table for the code points, corrected around stops by their
neighbours); a transducer of a dozen states reads the classes and says, at the first
character of a new unit, that the unit before it ended. Texts of a batch are joined into
one stream that is cut into equal chunks. A chunk is first run from all states at once,
which makes it a function of states; those functions are composed by a parallel prefix
scan, giving each chunk its entry state; a second run emits. Both runs are numpy steps
over all chunks, so a text of many megabytes costs no more per character than short ones.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tracemill.llm.common import map_texts

# Classes of characters.
BLANK, LINE, MARK, WEAK, QUOTE, BRACKET, START, LOWER, DIGIT, UNCASED, THAI, GOES_ON, SYMBOL, ITEM, VARIABLE, END, OPENER = range(17)
# States: nothing open; after ordinary text; after it blanks; after it a line break; the same three after an end mark, after
# a mark and a closing quote, after a mark and a closing bracket, after a weak mark (abbreviation, dots); after a Thai letter and after blanks behind it; after a blank line.
OPEN, W, WS, WN, T, TS, TN, Q, QS, QN, R, RS, RN, A, AS, AN, H, HS, CUT = range(19)
STATES, CLASSES = 19, 17
# What a step says of the unit before the character.
NONE, AT_MARK, AT_LAST = range(3)

#: Characters of one chunk of the stream.
CHUNK = 256

_MARKS = "!?。！？｡．।॥؟۔։።‼⁇⁈⁉‽"
_CLOSING_QUOTES = "”’»›」』〉》〞＂"
_OPENING_QUOTES = "„‚“‘«‹「『《〈〝¿¡"
_CLOSING_BRACKETS = ")]}）］｝】〕"
_OPENING_BRACKETS = "([{（［｛【〔"
_GOES_ON = ",;:，；：、،؛%‰°"

# Abbreviations with a stop, by what may follow.
#: Never the end of a sentence.
_NEVER = frozenset("vs cf resp incl bzw Fig fig Abb Tab Eq eq Sec Vol núm рис табл vgl ca viz см ср напр Mr Mrs Ms Dr Prof Hr Fr Sr Sra Mme Mlle St Gen Rev".split())
#: Not before a number, quoted or with a stray sign before it, or a bracket.
_BEFORE_NUMBER = frozenset("No Nos Nr num n Figs figs tab Eqs Secs vol Ch ch Art art Kap Bd Def Thm Lem Prop Cor Ex ex p pp S стр гл Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Jän Mär Okt Dez ene abr ago dic janv févr avr juil déc".split())
#: The end of a sentence only if a capital follows.
_MAY_END = frozenset("etc approx aprox env usw usf Inc Ltd Co Jr al min max sec ed eds r s г гг руб".split())
#: Abbreviations in two parts, by the same kinds.
_NEVER_PAIR = frozenset({("e", "g"), ("i", "e"), ("z", "B"), ("d", "h"), ("u", "a"), ("o", "ä"), ("p", "ex"), ("p", "ej"), ("т", "е"), ("т", "к")})
_MAY_END_PAIR = frozenset({("a", "m"), ("p", "m"), ("A", "M"), ("P", "M"), ("a", "C"), ("d", "C"), ("т", "д"), ("т", "п"), ("s", "w"), ("s", "o"), ("s", "u")})
_MAY_END_BEHIND_AND = frozenset({"др", "пр"})
_MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
_ARTICLES = frozenset("dem der den des die das am im zum zur vom beim".split())

_INNER_PARTS = frozenset(a for a, _ in _NEVER_PAIR | _MAY_END_PAIR) | {"u"}
_LONGEST = max(map(len, _NEVER | _BEFORE_NUMBER | _MAY_END))
#: What stands before a stop: an earlier part, and the letters or digits of the last word.
_TAIL_RE = re.compile(r"(?:(?<![^\W_])([^\W\d_])\.[ \t\n   ]?)?(?<![^\W_])([^\W\d_]+|\d{1,2})\Z")
_NUMBER_NEXT_RE = re.compile(r"\s{0,3}(?:[^\w\s]{1,4}\s?)?[^\W\d]?[\d(（\[#$]")
_PART_NEXT_RE = re.compile(r"\s?([^\W\d_]{1,2})\.")
_WORD_NEXT_RE = re.compile(r"\s([^\W\d_]+)")
_BEFORE_RE = re.compile(r"([^\W\d_]+)[ \t\n]\d{1,2}\Z")
_CAPITAL_NEXT_RE = re.compile(r"\s[A-ZÄÖÜ]")
_DOTS_RE = re.compile(r"\.{2,}|…+")
_INITIAL_NEXT_RE = re.compile(r"\s[A-ZÀ-ÞА-Я][^\W\d_]")
_ITEM_RE = re.compile(r"(?m)(?:^|(?<=\0))[ \t]*(?:([-*+•‣◦▪–—])[ \t]+(?=\S)|(\d{1,3}(?=[.)])|[A-Za-z](?=\)))([.)])[ \t]+(?=\S))")
_VARIABLE_RE = re.compile(r"(?<=[.!?…])(?:[\"”»)\]]*)(?:\s+|(?<=[^\W_]\.)|(?<=[?!]))([b-df-hj-np-tv-xz])(?= )")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, from its Unicode category."""
    table = np.full(0x110000, GOES_ON, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        if kind in ("Lu", "Lt"):
            k = START
        elif kind == "Ll":
            k = LOWER
        elif kind in ("Lo", "Lm", "Mn", "Mc", "Me"):
            k = THAI if 0x0E00 <= cp <= 0x0E7F else UNCASED
        elif kind in ("Nd", "Nl", "No"):
            k = DIGIT
        elif kind in ("Zs", "Cf") or c in "\t\x1f":
            k = BLANK
        elif kind in ("Zl", "Zp") or c in "\n\r\x0b\x0c\x85\x1c\x1d\x1e":
            k = LINE
        elif kind in ("So", "Sk", "Pd"):
            k = SYMBOL
        elif kind in ("Sc", "Sm"):
            k = START if c in "∴∵" else GOES_ON
        else:
            k = GOES_ON
        table[cp] = k
    for chars, k in ((_MARKS, MARK), (_CLOSING_QUOTES, QUOTE), (_CLOSING_BRACKETS, BRACKET), (_OPENING_QUOTES + _OPENING_BRACKETS + "$\\", OPENER), (_GOES_ON, GOES_ON), ("#*_`|~", START), ("-−+=<>/^&", GOES_ON), ("‍️​­﻿", SYMBOL)):
        for c in chars:
            table[ord(c)] = k
    table[0] = END
    return table


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next states and what is said, by state and class."""
    go = np.zeros((STATES, CLASSES), np.uint8)
    say = np.zeros((STATES, CLASSES), np.uint8)
    fresh = {MARK: T, WEAK: A, THAI: H}  # where the first character of a text or unit leads
    for s in range(STATES):
        for c in range(CLASSES):
            if c not in (BLANK, LINE, END):
                go[s, c] = fresh.get(c, W)
    go[OPEN, BLANK] = go[OPEN, LINE] = OPEN
    for plain, spaced, lined in ((W, WS, WN), (T, TS, TN), (Q, QS, QN), (R, RS, RN), (A, AS, AN)):
        go[plain, BLANK] = go[spaced, BLANK] = spaced
        go[plain, LINE] = go[spaced, LINE] = lined
        go[lined, BLANK], go[lined, LINE] = lined, CUT
    go[H, BLANK] = go[HS, BLANK] = HS
    go[H, LINE] = go[HS, LINE] = WN
    go[CUT, BLANK] = go[CUT, LINE] = CUT
    for c in range(CLASSES):
        if c not in (BLANK, LINE, END):
            say[CUT, c] = AT_LAST
    for s in range(STATES):
        if s != OPEN:
            say[s, END] = AT_LAST
        go[s, END] = OPEN
        if s not in (OPEN, CUT):
            say[s, ITEM] = AT_LAST
    say[HS, THAI] = AT_LAST
    for s in (T, Q, R, A):  # nothing between the mark and this
        go[s, QUOTE], go[s, BRACKET] = Q, R
        go[s, MARK], go[s, WEAK] = T, A
        go[s, SYMBOL] = s + 1
    for s, quote in ((TS, QS), (TN, QN), (AS, QS), (AN, QN), (QS, QS), (QN, QN), (RS, QS), (RN, QN)):
        go[s, QUOTE] = quote
        go[s, SYMBOL] = s
        go[s, BRACKET] = W
    for s in (T, TS, TN):
        for c in (START, OPENER, UNCASED, THAI, VARIABLE):
            say[s, c] = AT_MARK
    for s in (TS, TN):
        say[s, LOWER] = say[s, DIGIT] = AT_MARK
    for s in (Q, QS, QN, R, RS, RN, A, AS, AN):
        say[s, START] = say[s, VARIABLE] = AT_MARK
        if s in (A, AS, AN):
            go[s, OPENER] = AS  # what the quotation or formula begins with decides
        else:
            say[s, OPENER] = AT_MARK
    for s in (QS, QN, R, RS, RN):
        say[s, UNCASED] = say[s, DIGIT] = say[s, THAI] = AT_MARK
    say[R, DIGIT] = NONE
    for s in (AS, AN):
        say[s, UNCASED] = say[s, THAI] = AT_MARK
    return go, say


def _run(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is said at each character, and the state after it."""
    go, say = _machine()
    n = len(cls)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, END, np.uint8)
    grid[:n] = cls
    steps = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.int32)
    table = np.ascontiguousarray(go.T).ravel()  # by class, then state
    f = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    for c in steps:
        f = table[c[:, None] * STATES + f]
    reach = 1
    while reach < rows:  # prefix scan: the function of chunks 0..i
        f[reach:] = np.take_along_axis(f[reach:], f[:-reach].astype(np.int64), 1)
        reach *= 2
    s = np.concatenate([[OPEN], f[:-1, OPEN]]).astype(np.uint8)
    said, after = np.empty((CHUNK, rows), np.uint8), np.empty((CHUNK, rows), np.uint8)
    emit = np.ascontiguousarray(say.T).ravel()
    for i, c in enumerate(steps):
        k = c * STATES + s
        said[i] = emit[k]
        s = table[k]
        after[i] = s
    return said.T.ravel()[:n], after.T.ravel()[:n]


def _classify(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _classes()[cp]
    n = len(cp)
    before = np.concatenate([[0], cp[:-1]]).astype(np.uint32)
    after = np.concatenate([cp[1:], [0]]).astype(np.uint32)
    kb, ka = _classes()[before], _classes()[after]
    cls[(cp == 13) & (after == 10)] = BLANK  # one break, not two
    # Straight quotes open after a blank or an opening bracket, and right behind a mark if a letter follows.
    straight = np.flatnonzero((cp == ord('"')) | (cp == ord("'")) | (cp == ord("“")))
    b, a = kb[straight], ka[straight]
    wordish = np.isin(a, (START, OPENER, LOWER, DIGIT, UNCASED, THAI))
    is_open = np.isin(b, (BLANK, LINE, END)) | np.isin(before[straight], [ord(c) for c in _OPENING_BRACKETS]) | (((b == MARK) | (before[straight] == ord("."))) & wordish)
    cls[straight] = np.where(is_open, OPENER, QUOTE)
    apostrophe = straight[(cp[straight] == ord("'")) & np.isin(b, (START, LOWER, DIGIT, UNCASED))]
    cls[apostrophe] = np.where(np.isin(ka[apostrophe], (START, LOWER, UNCASED)), LOWER, QUOTE)
    low = np.flatnonzero(cp == ord("“"))  # closes where „ opens
    if len(low):
        opened = np.zeros(n, np.int8)
        opened[cp == ord("„")] = 1
        opened[low] = 2
        opened[(cp == 10) & (after == 10) | (cp == 0)] = 3
        at = np.maximum.accumulate(np.where(opened > 0, np.arange(n), 0))
        closing = low[(low > 0) & (opened[at[np.maximum(low - 1, 0)]] == 1)]
        cls[low] = OPENER
        cls[closing] = QUOTE
    stop = np.flatnonzero(cp == ord("."))
    b, a = kb[stop], ka[stop]
    spaced = np.isin(a, (BLANK, LINE, END))
    closer = np.isin(cls[np.minimum(stop + 1, n - 1)], (QUOTE, BRACKET)) | np.isin(after[stop], [ord(c) for c in "*_$"])
    wordy = np.isin(b, (LOWER, DIGIT, UNCASED, THAI, QUOTE, BRACKET)) | np.isin(before[stop], [ord(c) for c in "$%}\"'"])
    third = _classes()[cp[np.minimum(stop + 2, n - 1)]]
    glued = wordy & (((a == START) & np.isin(third, (LOWER, BLANK, LINE, START))) & (before[stop] != ord("/")) | np.isin(a, (UNCASED, THAI)) & (b != DIGIT) | np.isin(a, (UNCASED,)) & (b == DIGIT))
    glued &= ~((a == START) & (third == START) & np.isin(after[stop], range(65, 91)) & (b == START))
    opens = np.isin(after[stop], [ord(c) for c in _OPENING_QUOTES + '"('])
    cls[stop] = np.where(spaced | closer | glued | (opens & wordy), MARK, GOES_ON)
    mark = np.flatnonzero(np.isin(cp, [ord("!"), ord("?")]))
    cls[mark[np.isin(after[mark], [ord("="), ord("/")])]] = GOES_ON
    for m in _DOTS_RE.finditer(text):
        i, j = m.span()
        tail = text[j] if j < n else "\0"
        led = text[i - 1] if i else "\0"
        cls[i:j] = GOES_ON if tail.isdigit() or tail in ",;" or (tail.isalpha() and not tail.isupper()) else WEAK
        if led.isspace() and tail.isspace() and cls[j - 1] == WEAK:  # "1, 2, ... stops": part of the sentence
            cls[i:j] = WEAK
    for i in stop[cls[stop] == MARK].tolist() + [i for i in stop[cls[stop] == GOES_ON].tolist() if text[i + 1 : i + 2].isspace()]:
        kind = _stop_kind(text, i)
        if kind is not None and (kind == GOES_ON or cls[i] == MARK):
            cls[i] = kind
    for m in _VARIABLE_RE.finditer(text):
        i = m.start(1)
        cls[i] = VARIABLE
        if text[i - 1] == ".":
            cls[i - 1] = MARK if cls[i - 1] == GOES_ON and text[i - 2 : i - 1].isdigit() is False else cls[i - 1]
    _items(text, cls)
    return cls


def _stop_kind(text: str, i: int) -> int | None:
    """GOES_ON or WEAK for the stop of an abbreviation, an initial or an ordinal at place i; None for others."""
    m = _TAIL_RE.search(text, max(0, i - _LONGEST - 5), i)
    if m is None:
        return None
    part, word = m.groups()
    if word.isdigit():
        nxt = _WORD_NEXT_RE.match(text, i + 1)
        if nxt is None:
            return None
        if nxt.group(1) in _MONTHS:
            return GOES_ON
        before = _BEFORE_RE.search(text, max(0, m.start() - 12), i)
        return GOES_ON if before and before.group(1).lower() in _ARTICLES and _CAPITAL_NEXT_RE.match(text, i + 1) else None
    if len(word) <= 2:
        if word in _INNER_PARTS:
            nxt = _PART_NEXT_RE.match(text, i + 1)
            if nxt and ((word, nxt.group(1)) in _NEVER_PAIR or (word, nxt.group(1)) in _MAY_END_PAIR or (word, nxt.group(1)) == ("u", "s")):
                return GOES_ON
        if part:
            if (part, word) in _NEVER_PAIR:
                return GOES_ON
            if (part, word) in _MAY_END_PAIR:
                return WEAK
        if len(word) == 1 and word.isupper():
            if _INITIAL_NEXT_RE.match(text, i + 1) or (text[i + 1 : i + 2].isupper() and text[i + 2 : i + 3] == "."):
                return GOES_ON
        if word in _MAY_END_BEHIND_AND:
            return WEAK
    if word in _NEVER:
        return GOES_ON
    if word in _BEFORE_NUMBER and _NUMBER_NEXT_RE.match(text, i + 1):
        return GOES_ON
    return WEAK if word in _MAY_END else None


def _items(text: str, cls: np.ndarray) -> None:
    """Mark the first character of list items; the stop of a numbered item ends nothing."""
    item_line = -1  # where the line after the last item starts
    for m in _ITEM_RE.finditer(text):
        start = m.start()
        first = m.start(1) if m.group(1) else m.start(2)
        k = start - 1
        while k >= 0 and text[k] in "\r\n \t":
            k -= 1
        gap = text[k + 1 : start]
        block = k < 0 or text[k] == "\0" or gap.count("\n") > 1
        follows_item = item_line == start
        ended = k >= 0 and cls[k] in (MARK, QUOTE, WEAK) or k >= 0 and text[k] in ":;"
        nxt = text[m.end()]
        if m.group(1):
            ok = block or follows_item or ended or not (nxt.isdigit() or nxt in "\\$(=")
            ok = ok and not (m.group(1) in "–—" and not (block or follows_item))
        else:
            ok = block or follows_item or (ended and len(m.group(2)) < 3)
            if ok and m.group(2).isalpha() and not (block or follows_item):
                ok = False
        if ok:
            cls[first] = ITEM
            if not m.group(1):
                cls[m.start(3)] = GOES_ON
            end = text.find("\n", m.end())
            item_line = end + 1 if end >= 0 else -1


def unit_ends(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the ends of its units, as characters from its start."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    joined = "\0".join((t or "").replace("\0", " ") for t in texts) + "\0"
    cls = _classify(joined)
    said, after = _run(cls)
    n = len(cls)
    place = np.arange(n)
    solid = ~np.isin(cls, (BLANK, LINE, END))
    last_solid = np.maximum.accumulate(np.where(solid, place, -1))
    mark_run = np.isin(after, (T, Q, R, A)) | (np.isin(after, (QS, QN)) & (cls == QUOTE))
    last_mark = np.maximum.accumulate(np.where(mark_run, place, -1))
    at = np.flatnonzero(said)
    prior = np.maximum(at - 1, 0)
    end = np.where(said[at] == AT_MARK, last_mark[prior], last_solid[prior]) + 1
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    doc = np.searchsorted(starts, at, "right") - 1
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [end[cut[i] : cut[i + 1]] - starts[i] for i in range(len(texts))]


def sentence_units(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys and ``end_pos``, a row for each sentence unit of every text.

    ``end_pos`` counts code points from the start of the text to the end of the unit,
    with its end mark and the closing quotes and brackets behind it, without blanks.
    Null, empty and blank texts have no rows. Repeated rows give repeated units. Texts of
    any length are cut whole; the operator is narrow and needs no shuffle.
    """

    def run(texts: list[str | None]) -> list:
        ends = unit_ends(texts)
        return [np.repeat(np.arange(len(texts)), [len(x) for x in ends]), np.concatenate(ends) if ends else np.empty(0, np.int64)]

    return map_texts(df, run, keys, [text], {"end_pos": "int"}, explode=True)
