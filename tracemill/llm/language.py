"""Which language a text is in: votes of scripts and of common function words."""

from __future__ import annotations

import re
from collections import Counter

# Common function words.
STOPWORDS = {
    "en": "the of and to is that it for with as on this by we are be at from so not or which have has its an than then let us one all each into if where but were was can only when because",
    "de": "der die das und ist nicht mit den wir von sich des ein eine einen dem zu auf für als auch es an werden aus er hat dass sie nach wird bei noch wie einem über so zum oder durch man nur beide also gilt",
    "fr": "le la les des et est que dans une par on un du en pour qui il sur ne se pas plus avec ce au sont ou cette deux donc ainsi aux reste vaut soit si comme sous ici car",
    "es": "el la los las de que y en una es por con un para del se al lo como más o su hay si entre sobre también pero esta cada queda esto cuando así solo sea otros",
    "it": "il la di che e un una per non con del le si da in sono dei al come più anche alla nel questo ma della gli",
    "pt": "o a os as de que e um uma para com não em do da no na por se mais dos como mas ao das seu sua",
    "nl": "de het een en van is dat op te in met voor niet zijn aan er om ook als dan maar bij uit door naar",
    "tr": "ve bir bu için ile olarak da de çok daha olan gibi ise ne kadar her sonra",
    "pl": "i w na z do nie to że się o jest od za po jak ale przez dla tak",
    "ru": "и в не на что с по это к как но из за то все так же от для мы при или обе если где",
}
_BY_WORD: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        if len(_w) < 2 or _lang == "ru":  # single letters are variables as often as words; Russian is told by its script
            continue
        _BY_WORD[_w] = (*_BY_WORD.get(_w, ()), _lang)
#: The different sets of languages, and the number (from 1) of each word's set.
_SETS = [(), *dict.fromkeys(_BY_WORD.values())]
_SET_OF = {w: _SETS.index(langs) for w, langs in _BY_WORD.items()}

_LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes of ASCII text as small letters and blanks.
_SMALL = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else 32 for c in range(256))
#: First and last code points of scripts that name a language by themselves.
SCRIPTS = ((0x0370, 0x03FF, "el"), (0x0400, 0x04FF, "ru"), (0x0590, 0x05FF, "he"), (0x0600, 0x06FF, "ar"), (0x0900, 0x097F, "hi"), (0x0E00, 0x0E7F, "th"), (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "ko"))


def function_votes(words: list[str]) -> dict[str, float]:
    """Votes by language of the function words alone."""
    out: dict[str, float] = {}
    for s, n in Counter(filter(None, map(_SET_OF.get, words))).items():
        for lang in _SETS[s]:
            out[lang] = out.get(lang, 0) + n
    return out


def votes_of(words: list[str]) -> dict[str, float]:
    """Votes by language of case-folded words: a function word has one, letters of another script a quarter each (Chinese and Japanese three quarters)."""
    out = function_votes(words)
    if "".join(words).isascii():
        return out
    seen: dict[str, int] = {}
    for w in words:
        if w >= "\u0370":
            cp = ord(w[0])
            for low, high, name in SCRIPTS:
                if low <= cp <= high:
                    seen[name] = seen.get(name, 0) + len(w)
                    break
    if seen:
        if "kana" in seen:
            seen["ja"] = seen.pop("kana") + seen.pop("han", 0)
        elif "han" in seen:
            seen["zh"] = seen.pop("han")
        for k, v in seen.items():
            out[k] = v * (0.75 if k in ("zh", "ja") else 0.25)
    return out


def ascii_words(text: str) -> list[str]:
    """Runs of letters of an ASCII text, as small letters."""
    return text.encode().translate(_SMALL).decode().split()


def votes(text: str) -> dict[str, float]:
    return function_votes(ascii_words(text)) if text.isascii() else votes_of(_LETTERS.findall(text.casefold()))


def vote(text: str | None) -> str:
    """The language with most votes; '' without any."""
    return most(votes(text)) if text else ""


def most(v: dict[str, float]) -> str:
    return max(v, key=lambda k: (v[k], k)) if v else ""
