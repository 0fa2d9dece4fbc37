"""Broken question-answer pairs: empty, truncated, refused, copied, in another language.

Each pair is judged on its whole texts, independent of all others, in Arrow batches.  The one
thing learned from the corpus is a lexicon of words by language, from all questions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Phrases, SuffixAutomaton, covered, left_open

#: Words of the lexicon at most; the most frequent are kept.
LEXICON = 20_000

STOPWORDS = {
    "en": "the and of to in is are for with on at by that this it as be may must should can has have was were if when what where which who why how not no from before after until than more under an or you any each every do does so".split(),
    "fr": "le la les des et un une du au aux dans pour que qui est sont sur avec par ne pas il elle ce cette se peut doit faut comment pourquoi où quand puis afin sous si tous après avant tant près".split(),
    "de": "der die das den dem des und ein eine einen einem einer ist sind im am zu auf mit für von nicht man darf muss soll kann wer wie warum wann wo wenn dass weil nach vor bei hinter unter neben damit bevor um gilt".split(),
    "es": "el los las una unos y que en para por con del al se es son no debe puede hay como cómo qué quién dónde cuándo si antes después sobre bajo junto porque cada hasta luego tras queda".split(),
}
#: Frequent words of further languages that the four above don't have, for answers only.
FURTHER = {
    "it": "gli della delle dello degli nel nella nelle dal dalla che è sono anche più questo questa essere quando deve ogni dopo prima senza viene con quello".split(),
    "pt": "não uma são com mais dos das ao pelo pela também deve cada depois isso está num numa à às até são".split(),
    "pl": "się nie jest oraz przez dla jak które który musi może po od przed powinien należy być każdy albo lub jeśli gdy".split(),
    "nl": "het een niet zijn worden wordt voor met ook aan naar moet bij deze dit niet als kan uit daarna".split(),
}
#: Whole answers that say nothing.
NOTHING = set("null none n/a na nil nan blank empty undefined void".split())
LABELS = r"(?:answer|antwort|réponse|respuesta|response|reply|sources?|quellen?|fuentes?|q|question|frage|pregunta|re|aw|you asked|note)"

#: What a refusal says, lower-cased, with plain apostrophes.
REFUSALS = [
    "i don't know", "i do not know", "i have no idea", "i'm not sure", "i am not sure", "unable to help", "unable to answer", "i can't answer", "i cannot answer",
    "i can't help", "i cannot help", "can't assist", "cannot assist", "must decline", "decline to", "request is declined", "rather not give advice", "rather not answer",
    "insufficient evidence", "not enough evidence", "not enough information", "sources are silent", "no reply is given", "no relevant passage",
    "passages do not cover", "nothing in the sources", "nothing on file", "lies outside what i may", "outside what i may discuss", "leave this unanswered", "not something i can",
    "impossible for me to", "reliable reply cannot", "question stays open", "not found in the provided", "not allowed to answer",
    "n'en sais rien", "je ne sais pas", "ne peux pas répondre", "ne peux répondre", "se prononcer sur", "sort de mon domaine", "sources sont insuffisantes",
    "passages trouvés ne traitent pas", "dois refuser", "cette demande est refusée", "aucune information", "impossible de répondre",
    "das weiß ich nicht", "ich weiß es nicht", "kann ich nichts sagen", "behandeln das nicht", "reichen für eine auskunft nicht", "anfrage wird abgelehnt", "liegt nichts vor",
    "darauf nicht antworten", "kann ich nicht beantworten", "keine auskunft", "keine antwort geben", "nicht zuständig",
    "no lo sé", "no puedo responder", "fuera de mi alcance", "no hay datos suficientes", "rechazar la petición", "pasajes hallados no tratan", "página permite opinar",
    "no puedo contestar", "no puedo ayudar", "no dispongo de información", "petición rechazada",
]
#: Refusals by their build: the speaker, a denied ability or will, and what is asked of an answer; and rules that bind the speaker.
_I_WONT = re.compile(
    r"\bi(?:'m| am)? (?:really |simply |also )?(?:can't|cannot|can not|couldn't|could not|won't|will not|would rather not|'d rather not|must not|unable|not able|not allowed|not permitted|not in a position|don't feel able|do not feel able)\b[^.!?]*\b(?:provide|answer|help|assist|discuss|comment|share|give|tell|say|advise|respond|reply|comply|offer|support|do that|do this)\b"
    r"|\b(?:against|violates?|outside|breach(?:es)?) (?:of )?my (?:guidelines?|polic(?:y|ies)|rules|instructions|remit)|\bas an ai\b|\bje (?:ne|n')[^.!?]{0,12}(?:peux|puis|suis|sais|veux)[^.!?]{0,20}\b(?:répondre|aider|fournir|donner|dire|discuter|commenter|autorisé)"
    r"|\b(?:ich|dazu|darauf|darüber) (?:kann|darf|möchte|werde)\b[^.!?]*\b(?:nicht|keine|nichts)\b[^.!?]*\b(?:antworten|beantworten|helfen|geben|sagen|mitteilen|weiterhelfen|besprechen|bereitstellen)\b|\bno (?:puedo|debo|quiero|me es posible|estoy autorizad[oa] a)\b[^.!?]*\b(?:responder|contestar|ayudar|dar|decir|proporcionar|hablar|comentar)\w*"
)
#: Words without which no refusal is built so.
_SPEAKER = re.compile(r"\b(?:i|i'm|i'd|my|an ai|je n\W?e?|ich|dazu|darauf|darüber|no (?:puedo|debo|quiero|me es|estoy))\b")
#: What may stand beside a refusal without answering anything.
COURTESIES = [
    "sorry", "i'm afraid that", "i am afraid that", "to be frank", "unfortunately", "thank you for asking", "however", "hmm", "note", "try another wording", "a manual check is advised",
    "please ask", "is there anything else", "désolé", "malheureusement", "veuillez consulter", "leider", "entschuldigung", "tut mir leid",
    "bitte fragen sie", "lamentablemente", "lo siento", "consulte a", "sources: none", "code",
]

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_TAG = re.compile(r"<[^<>]{1,40}>")
_LABEL = re.compile(rf"^[\s#*>\"'“«]*{LABELS}\s*:?[\s*:]*(?=\n|:|$)|^[\s#*>]*{LABELS}\s*:\s*", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_ROW = re.compile(r"^[^|\n]+(?:\|[^|\n]*)+$")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+(.*)$")
_SOURCE = re.compile(r"^(?:sources?|quellen?|fuentes?)\s*:\s*(?:none|[A-Z]_\d+(?:\s*,\s*[A-Z]_\d+)*)\.?$", re.I)
_AMOUNT = re.compile(r"^[-+]?\d+(?:[.,]\d+)?\s*[°%a-zµ]")
#: A short instruction or statement whose last word is the unit of an amount.
_MEASURED = re.compile(r"\d\s*(?:°\s*[CF]|%|min|h|s|d|ml|µl|l|g|mg|kg|µg|mm|cm|m|rpm|bar|hours?|minutes?|seconds?|days?|weeks?|months?|years?)$")
_YES_NO = {"yes": "en", "oui": "fr", "non": "fr", "ja": "de", "nein": "de", "sí": "es", "no": "", "si": ""}
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|«[^«»]*»|“[^“”]*”|\"[^\"]*\"")


_BLOCKS = [("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]


_LETTER = re.compile(r"[^\W\d_]")


def _script(text: str) -> str | None:
    """The script of most letters of ``text``; kana and han are one."""
    if text.isascii() or max(text) < "\u0250":
        return "latin" if _LETTER.search(text) else None
    n: Counter[str] = Counter()
    for c in text:
        if c.isalpha():
            n[next((name for name, lo, hi in _BLOCKS if lo <= ord(c) <= hi), "other")] += 1
    if not n:
        return None
    best = n.most_common(1)[0][0]
    return "han" if best == "kana" else best


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text.replace("’", "'"))]


class Judge:
    def __init__(self, lexicon: dict[str, str]) -> None:
        self.stop = {w: lang for lang, ws in STOPWORDS.items() for w in ws if sum(w in o for o in STOPWORDS.values()) == 1}
        self.further = {w: lang for lang, ws in FURTHER.items() for w in ws if w not in self.stop and all(w not in o for o in STOPWORDS.values()) and sum(w in o for o in FURTHER.values()) == 1}
        self.lexicon = lexicon
        self.refusal = Phrases([(p, True) for p in REFUSALS] + [(p, False) for p in COURTESIES])

    def defect(self, question: str | None, answer: str | None) -> str | None:
        q, a = question or "", answer or ""
        core = _TAG.sub("", a.replace("​", "").replace("﻿", "")).strip()
        stripped = core
        for _ in range(3):
            stripped = _LABEL.sub("", stripped, count=1).strip()
        said = words(stripped)
        if not said or (len(said) <= 2 and " ".join(said) in NOTHING) or stripped.strip("()[]. ").lower() in NOTHING:
            return "empty"
        if self.copied(q, stripped):
            return "copy"
        rest = self.without_question(q, stripped)
        if self.refused(rest):
            return "refusal"
        if self.foreign(q, rest):
            return "other_language"
        if self.cut_off(core):
            return "truncated"
        return None

    def copied(self, q: str, a: str) -> bool:
        """Whether the answer holds hardly a word beyond runs of the question, and most of the question."""
        qw, aw = words(q), words(a)
        if not qw or not aw:
            return False
        s = SuffixAutomaton()
        s.add(qw)
        least = min(2, len(qw))
        hit = covered(s.matching_lengths(aw), least)
        back = SuffixAutomaton()
        back.add(aw)
        return hit >= 0.9 * len(aw) and covered(back.matching_lengths(qw), least) >= 0.6 * len(qw)

    def without_question(self, q: str, a: str) -> str:
        """The answer without the question that it repeats at its start."""
        key = q.strip().rstrip("?.! …").lstrip("¿¡ ").lower()
        low = a.lower()
        at = low.find(key) if len(key) >= 8 else -1
        if 0 <= at <= 12:
            return a[at + len(key) :].lstrip(" ?.!…\"”»\n:-")
        return a

    def refused(self, a: str) -> bool:
        text = a.replace("’", "'").lower()
        spans = self.refusal.spans(text)
        built = bool(_SPEAKER.search(text)) and bool(_I_WONT.search(text))
        if not built and not any(v for _, _, v in spans):
            return False
        refusing = other = 0
        for part in _SENTENCE.split(text):
            if not part.strip():
                continue
            hits = self.refusal.spans(part)
            n = len(words(part))
            if any(v for _, _, v in hits) or built and _I_WONT.search(part):
                refusing += n
            elif not (hits or n <= 3 or _SOURCE.match(part.strip())):
                other += n
        return other <= 4

    def votes(self, ws: list[str]) -> dict[str, int]:
        out = dict.fromkeys(STOPWORDS, 0)
        for w in ws:
            lang = self.stop.get(w)
            if lang:
                out[lang] += 2
            elif lang := self.lexicon.get(w):
                out[lang] += 1
        return out

    def language(self, ws: list[str]) -> tuple[str | None, dict[str, int]]:
        v = self.votes(ws)
        best = max(v, key=v.get)
        second = max((n for k, n in v.items() if k != best), default=0)
        return (best if v[best] > second else None), v

    def foreign(self, q: str, a: str) -> bool:
        mine, asked = self.language(words(q))
        if _script(q) and _script(a) and _script(q) != _script(a):
            return True
        plain = _BRACKETS.sub(" ", a)
        ws = words("\n".join(x for x in plain.split("\n") if not _SOURCE.match(x.strip())))
        if mine is None or not ws:
            return False
        if len(ws) <= 2 and _YES_NO.get(ws[0]):
            return _YES_NO[ws[0]] != mine
        theirs, v = self.language(ws)
        beyond = Counter(self.further[w] for w in ws if w in self.further)
        if beyond and (n := max(beyond.values())) >= 3 and 8 * n >= len(ws) and 2 * n > max(v.values()) and not any(w in self.further for w in words(q)):
            return True
        return theirs is not None and theirs != mine and v[theirs] >= 3 and v[theirs] >= 2 * v[mine] + 1

    def cut_off(self, a: str) -> bool:
        a = a.strip()
        if left_open(a):
            return True
        lines = [x.strip() for x in a.split("\n") if x.strip()]
        last = lines[-1]
        if re.fullmatch(r"(?:\d{1,3}[.)]|[-*•–])", last):
            return True
        if last.endswith(("...", "…", ",", ";", ":", "-", "–", "/", "¿", "¡", "(")):
            return True
        if _SOURCE.match(last):
            return len(lines) > 1 and self.cut_off("\n".join(lines[:-1]))
        if re.match(r"^(?:sources?|quellen?|fuentes?)\s*:", last, re.I):
            return True
        if _ROW.match(last):
            rows = [x for x in lines if _ROW.match(x)]
            return last.count("|") < max(x.count("|") for x in rows) or not last.rsplit("|", 1)[1].strip()
        if last[-1] in ".!?)]}»”\"*`":
            return bool(_ITEM.match(last) and not words(_ITEM.match(last)[1]))
        if item := _ITEM.match(last):
            head, colon, tail = item[1].partition(":")
            mates = [m[1] for x in lines[:-1] if (m := _ITEM.match(x))]
            if not colon:
                return not mates or any(":" in m or m[-1:] in ".!?" for m in mates) or len(item[1].split()) < 2
            return len(tail.split()) < min([2, *(len(m.partition(":")[2].split()) for m in mates if ":" in m)])
        ws = words(last)
        if len(lines) == 1 and ws and ws[0] in _YES_NO and len(ws) <= 4:
            return False
        if len(lines) == 1 and _AMOUNT.match(last) and len(ws) <= 12:
            return False
        if len(lines) == 1 and _MEASURED.search(last) and len(last.split()) <= 8:
            return False
        if last.endswith("°"):
            return True
        return len(ws) >= 3 or len(lines) > 1


def _among(values: list[str]):
    return lambda x: x.isin(*values)


def lexicon(pairs: DataFrame, size: int = LEXICON) -> dict[str, str]:
    """Words of the questions that belong to one language, learned from all questions.

    A question's language is the one whose stopwords it holds most; a word belongs to a language with
    nine tenths of its uses.  At most ``size`` words, so the result is bounded.
    """
    ws = F.regexp_extract_all(F.lower("question"), F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"), F.lit(0))
    df = pairs.select(ws.alias("w"))
    hits = [F.size(F.filter("w", _among(ls))).alias(k) for k, ls in STOPWORDS.items()]
    df = df.select("w", *hits)
    top = F.greatest(*STOPWORDS)
    ties = sum((F.col(k) == top).cast("int") for k in STOPWORDS)
    lang = F.coalesce(*[F.when((F.col(k) == top) & (top > 0) & (ties == 1), F.lit(k)) for k in STOPWORDS])
    seen = df.select(F.explode(F.array_distinct("w")).alias("word"), lang.alias("lang")).where("lang is not null and length(word) > 2")
    per = seen.groupBy("word", "lang").agg(F.count("*").alias("n")).groupBy("word").agg(F.max_by("lang", "n").alias("lang"), F.max("n").alias("best"), F.sum("n").alias("n"))
    rows = per.where("best >= 0.9 * n and n >= 3").orderBy(F.desc("n"), "word").limit(size).collect()
    return {r["word"]: r["lang"] for r in rows}


def broken_answers(pairs: DataFrame) -> DataFrame:
    """Defective pairs of ``pairs`` (answer_id BIGINT, question STRING, answer STRING): answer_id, defect.

    A pair has one defect at most, the first of: empty, copy, refusal, other_language, truncated.
    A null or blank answer is empty, whatever the question; a null question can make no copy
    and no other_language; ``confidence`` does not decide, as it is dirty; rows with a null id are kept;
    repeated rows come out repeated; extra columns are ignored; an empty table gives an empty result.
    """
    bc = pairs.sparkSession.sparkContext.broadcast(lexicon(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bc.value)
        for b in batches:
            out = [judge.defect(q, a) for q, a in zip(b[1].to_pylist(), b[2].to_pylist())]
            keep = pa.array([i for i, d in enumerate(out) if d], pa.int64())
            yield pa.RecordBatch.from_arrays([b[0].take(keep), pa.array([d for d in out if d], pa.string())], names=["answer_id", "defect"])

    return pairs.select(F.col("answer_id").cast("long"), F.col("question").cast("string"), F.col("answer").cast("string")).mapInArrow(run, "answer_id long, defect string")
