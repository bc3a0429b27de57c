"""Answers that are none: empty, cut off, a refusal, the question given back, another language."""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import answers, map_texts, traces
from tracemill.llm.fillers import bare, only_fillers, units
from tracemill.llm.language import ascii_words, function_votes, most, votes_of
from tracemill.llm.truncation import FEATURES, SCORED, EndModel, decided, end_features, end_odds, scored_by_all, truncated_texts
from tracemill.session import materialize

_SENTENCE = re.compile(r"[^.!?。！？।؟\n]+(?:[.!?。！？।؟]+(?=\S)[^.!?。！？।؟\n]+)*")
_WORKS = re.compile(r"[\d=+<>^\\∑√∫]")
_UNIT = re.compile("[A-Za-z0-9]")
_BLANKS = bytes.maketrans(b"\t\n\v\f\r\x1c\x1d\x1e\x1f", b" " * 9)
_FIRST = re.compile(r"^.*?(?:[.!?।؟](?=\s)|[。！？]|\n\s*\n)", re.S)

# Fixed values.
#: Phrases of refusal, letter case and blanks as below.
REFUSALS = (
    "i can't help with|i cannot help with|i can't assist|i cannot assist|cannot assist with|can't assist with|i am unable to|i'm unable to|unable to help|unable to assist|unable to provide|unable to answer|i won't provide|i will not provide|i won't be able|i can't provide|i cannot provide|i can't answer|i cannot answer|i can't solve this|i cannot solve this|i must decline|i have to decline|i decline to|must respectfully decline|i refuse to|i'm not able to|i am not able to|not able to solve tasks|as a language model|as an ai|as an artificial intelligence|my guidelines|against my guidelines|prevent me from|goes beyond what i am allowed|not allowed to|i'm not permitted|i am not permitted|not comfortable|do not feel comfortable|don't feel comfortable|it would be inappropriate|inappropriate for me|ask a teacher instead|i'd rather not|i would rather not|i can't do that|i cannot do that|cannot fulfill|can't fulfill|cannot comply|can't comply|cannot complete this request"
    "|kann ich nicht helfen|kann ich leider nicht|ich kann ihnen nicht|ich kann dir nicht|ich kann diese aufgabe nicht|ich kann diese frage nicht|muss ich leider ablehnen|muss ich ablehnen|ich muss ablehnen|darf ich nicht|ich darf diese|nicht gestattet|nicht erlaubt|es tut mir leid|tut mir leid|bin nicht in der lage|ich bin nicht befugt|als sprachmodell|als ki"
    "|je ne peux pas|je suis désolé|je suis désolée|désolé, mais|je ne suis pas en mesure|je ne suis pas autorisé|il ne m'est pas permis|il m'est impossible|je dois refuser|je dois décliner|je refuse|en tant que modèle|en tant qu'ia|ne puis pas"
    "|lo siento|no puedo ayudar|no puedo resolver|no puedo proporcionar|no puedo dar|no puedo responder|no me está permitido|no estoy autorizado|no me es posible|debo rechazar|tengo que rechazar|debo declinar|como modelo de lenguaje|no soy capaz"
    "|я не могу|не могу помочь|не могу решить|не могу ответить|не могу предоставить|не могу выполнить|извините|к сожалению, я|мне не разрешено|мне нельзя|вынужден отказать|я вынужден|я должен отказать|отказаться от ответа|как языковая модель|не имею права|прошу прощения|приношу извинения|мне запрещено|не в состоянии"
    "|对不起|抱歉|我不能|我无法|不能提供|无法提供|无法解答|不能解答|不能回答|无法回答|不能帮助|无法帮助|无法协助|作为语言模型|作为一个语言模型|作为人工智能|作为一个人工智能|不允许|请谅解|拒绝回答|恕我"
).split("|")
#: Share of a text's words outside its sentences of refusal that may stand in sentences that work on the task (hold a digit or a sign of calculation).
WORK_SHARE = 0.5
#: Share of the answer that must lie in runs of the question, least length of such runs, and words a lead-in may have.
COPY_SHARE, COPY_RUN, LEAD_IN = 0.75, 4, 14
#: Words among which most texts have more than LEAD_IN that the question lacks.
_ENOUGH = 60


@lru_cache(maxsize=1)
def _refusal_automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in REFUSALS:
        a.add_word(p, len(p))
    a.make_automaton()
    return a


def _one_line(text: str) -> str:
    """The text with each run of blanks as one."""
    if not text.isascii():
        return " ".join(text.split())
    text = text.encode().translate(_BLANKS).decode()
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def refuses(text: str) -> bool:
    """Whether a sentence of a bare text holds a phrase of refusal and the rest, of whatever length, mostly does no work on the task."""
    plain = text.casefold().replace("’", "'")
    if next(_refusal_automaton().iter(_one_line(plain)), None) is None:
        return False
    work = rest = 0
    found = False
    for m in _SENTENCE.finditer(plain):
        sentence = " ".join(m.group().split())
        if next(_refusal_automaton().iter(sentence), None) is not None:
            found = True
            continue
        n = len(units(sentence))
        rest += n
        work += n if _WORKS.search(sentence) else 0
    return not found or work <= WORK_SHARE * rest


class SuffixAutomaton:
    """All runs of a list of words: from each state the longest match goes on, or falls back along suffix links."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.size[p] + 1 == self.size[q]:
                    self.link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def covered(self, words: list[str], run: int) -> int:
        """How many of the words lie in runs of at least ``run`` words of the automaton's text."""
        nxt, link, size = self.next, self.link, self.size
        state = length = total = 0
        end = -1  # words before this place are counted
        for i, w in enumerate(words):
            step = nxt[state].get(w)
            while step is None and state:
                state = link[state]
                length = size[state]
                step = nxt[state].get(w)
            if step is None:
                length = 0
                continue
            state = step
            length += 1
            if length >= run:
                start = max(i + 1 - length, end)
                total += i + 1 - start
                end = i + 1
        return total


class _Question:
    """A prompt's words, the votes for its language and, once asked for, its automaton."""

    def __init__(self, prompt: str):
        w = units(prompt)
        self.words, self.size, self.votes, self.known = w, len(w), votes_of(w), frozenset(w)

    @cached_property
    def automaton(self) -> SuffixAutomaton:
        return SuffixAutomaton(self.words)

    def copied(self, words: list[str]) -> bool:
        """Whether a text of these words is the question and a lead-in."""
        covered = self.automaton.covered(words, COPY_RUN)
        return covered >= COPY_SHARE * len(words) and len(words) - covered <= LEAD_IN and covered >= 0.5 * self.size


_question = lru_cache(maxsize=64)(_Question)


def _foreign(question: dict[str, float], v: dict[str, float]) -> bool:
    """Whether a text's votes are for another language than the question's."""
    if not question or not v:
        return False
    asked, best = most(question), most(v)
    return question[asked] >= 2 and best != asked and v[best] >= 4 and v[best] >= 2.0 * v.get(asked, 0)


def _rest(text: str, words: list[str]) -> list[str]:
    """The words of a text apart from its first sentence; all where that leaves none."""
    m = _FIRST.match(text)
    return (words[len(units(text[: m.end()])) :] if m else []) or words


def _judged(prompt: str | None, text: str | None) -> tuple[str | None, dict[str, float] | None]:
    """What ``defect_of`` gives, and the votes of the whole bare text where they were counted by the way.

    A word that the question lacks lies in no run of it, so the automaton is only asked
    where at most LEAD_IN words are such. In ASCII text the letters tell that and the votes;
    a first sentence ends in a blank, so votes of its words and of the rest add up.
    """
    if not text:
        return "empty", None
    text = bare(text)
    if only_fillers(text):
        return "empty", None
    if refuses(text):
        return "refusal", None
    if not prompt:
        return None, None
    q = _question(prompt)
    if not text.isascii():
        w = units(text)
        if q.size >= COPY_RUN and len(set(w) - q.known) <= LEAD_IN and q.copied(w):
            return "copy", None
        return "language" if _foreign(q.votes, votes_of(_rest(text, w))) else None, None
    m = _FIRST.match(text)
    at = m.end() if m else 0
    first, rest = ascii_words(text[:at]), ascii_words(text[at:])
    some = first if len(first) > _ENOUGH else first + rest[:_ENOUGH]
    if q.size >= COPY_RUN and len(set(some) - q.known) <= LEAD_IN and len(set(first).union(rest) - q.known) <= LEAD_IN and q.copied(units(text)):
        return "copy", None
    own = function_votes(rest)
    votes = dict(own)
    for lang, n in function_votes(first).items():
        votes[lang] = votes.get(lang, 0) + n
    if not rest and not _UNIT.search(text, at):
        own = votes
    return "language" if _foreign(q.votes, own) else None, votes


def defect_of(prompt: str | None, text: str | None) -> str | None:
    """'empty', 'refusal', 'copy' or 'language'; None for other texts. Cut texts are found by the end model."""
    return _judged(prompt, text)[0]


def defects(df: DataFrame, prompt: str, text: str, column: str, keys: list[str], model: EndModel | None = None, tokens: str | None = None) -> DataFrame:
    """keys and ``defect`` of every answer: 'empty', 'refusal', 'copy', 'language', 'truncated' or null.

    The first that holds in that order is given. ``prompt`` is the question, ``column`` the
    name of the field the answer is from, ``tokens`` may name a column of token counts.
    Null answers, blanks, tags and fillers are 'empty'; with a null or empty prompt 'copy'
    and 'language' are not given. Repeated rows stay. One pass over the texts writes a
    narrow table. Unless a model of ends is given, contexts are counted over every
    different text (see ``truncation.scored_by_all``); thresholds are set from the scores of
    all answers without another defect.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None], prompts: list[str | None]) -> list:
        judged = [_judged(p, t) for p, t in zip(prompts, texts)]
        out = [d for d, _ in judged]
        left = [None if d else t for t, d in zip(texts, out)]
        told = [v for _, v in judged]
        return [out, *(end_odds(sent.value, left, prompts, told) if sent.value else end_features(left, prompts, told))]

    carried = [*keys, tokens] if tokens and tokens not in keys else keys
    named = df.select(*carried, F.col(text).alias("__t"), F.col(prompt).alias("__p"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("__field"))
    scored = materialize(map_texts(named, run, [*carried, "__field"], ["__t", "__p"], {"__defect": "string"} | (SCORED if model else FEATURES)))
    if not model:
        model, scored = EndModel(), materialize(scored_by_all(df, text, scored))
    return decided(scored, model, tokens).select(*keys, F.coalesce("__defect", F.when(F.col("cut"), "truncated")).alias("defect"))


def _field(df: DataFrame) -> DataFrame:
    return df.withColumn("__field", F.when(F.col("slot").isin("chosen", "rejected"), F.concat("slot", F.lit("_solution"))).otherwise("solution"))


def defective_answers(rollouts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record_table, record_id, slot, defect) of every defective answer, each once."""
    found = defects(_field(answers(rollouts, pairs)), "problem_text", "solution", "__field", ["record_table", "record_id", "slot"], tokens="num_tokens")
    return found.filter("defect is not null").distinct()


def _cut(rollouts: DataFrame) -> DataFrame:
    t = traces(rollouts).withColumn("__column", F.lit("solution"))
    return truncated_texts(t, "solution", "__column", ["rollout_id", "trace_id", "shard"], tokens="num_tokens", question="problem_text")


def cut_traces(rollouts: DataFrame) -> DataFrame:
    """(rollout_id, trace_id) of traces whose solution breaks off, each once."""
    return _cut(rollouts).filter("cut").select("rollout_id", "trace_id").distinct()


def cut_rates(rollouts: DataFrame) -> DataFrame:
    """(shard, traces, with_text, cut, cut_rate): how often each source's texts break off; twice delivered rows count once.

    Null shards are one group; a shard without texts has rate 0.
    """
    d = _once(_cut(rollouts))
    return d.groupBy("shard").agg(F.count("*").alias("traces"), F.sum("with_text").alias("with_text"), F.sum("cut").alias("cut")).withColumn("cut_rate", F.col("cut") / F.greatest("with_text", F.lit(1)))


def _once(found: DataFrame) -> DataFrame:
    return found.groupBy("shard", "rollout_id", "trace_id").agg(F.max(F.col("cut").cast("bigint")).alias("cut"), F.max(F.col("has_text").cast("bigint")).alias("with_text"))
