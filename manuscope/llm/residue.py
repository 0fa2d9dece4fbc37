"""Template residue, filler text, error pages and script notices in documents.

A multi-pattern automaton marks known phrases of many languages; placeholders have a small grammar of their own.
Error, filler and script phrases are residue only when what they cover, with what usually stands around
them, is most of the document, so that content that mentions an error stays.  A placeholder counts where a value
belongs: not in code, not as a key to press, not in a sentence about templates, and in notations that also have other
uses only if the corpus has the same field in several notations.

Filler is learned from the corpus, in one pass over all documents: the words of lines without any language in documents
of the mock text that begins with "lorem", and the letter groups of texts whose words are put together from
few parts.  A text in a language that is not known here has neither, and stays.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .answers import STOPWORDS
from .automata import Phrases

#: Share of a document's letters that matched lines must hold.
COVERAGE = 0.6
#: Share of a line that its phrases must cover to make it residue; below it the line only mentions them.
LINE_COVERAGE = 0.3
#: Share of stopwords from which on a text can't be residue for the most part (mock text and mashed keys have none).
SPOKEN = 0.25
#: Notations in which a field must occur in the corpus to be one in notations with other uses.
NOTATIONS = 2
#: Least share of a learned name, word or letter group in its kind: at most 100,000 names, 500 words, and groups of three letters.
NAME_SHARE, WORD_SHARE, UNIT_SHARE = 1e-5, 2e-3, 0.2
#: Share of letters in recurring groups from which on words are put together from parts: by the text alone, and by learned groups.
MADE_UP, MADE_UP_LEARNED = 0.6, 0.5

#: What asks for scripts, by language: verbs before what they ask for.
_SCRIPT = [
    (["enable", "turn on", "switch on", "activate", "allow", "permit", "requires", "require", "needs", "need", "blocks", "without", "supports"], ["javascript", "js", "scripts", "scripting", "client-side scripting", "client-side scripts", "active content"]),
    (["activer", "activez", "autoriser", "autorisez", "exige", "nécessite", "requiert"], ["javascript", "js", "les scripts", "des scripts", "l'exécution de scripts", "l'exécution de javascript"]),
    (["aktivieren sie", "erlauben sie", "schalten sie", "benötigt", "braucht", "erfordert", "bitte"], ["javascript", "js", "skripte", "skripts"]),
    (["active", "activar", "habilite", "permita", "permitir", "debe permitir", "requiere", "necesita"], ["javascript", "js", "los scripts", "scripts"]),
    (["abilita", "abilitare", "attiva", "attivare", "richiede"], ["javascript", "gli script"]), (["ative", "habilite", "requer", "precisa de"], ["javascript", "os scripts"]),
    (["włącz", "włączyć", "wymaga", "wymagany jest"], ["javascript", "javascriptu", "obsługę javascript"]), (["включите", "требуется", "необходим"], ["javascript", "скрипты"]), (["schakel", "vereist"], ["javascript", "scripts"]),
]
#: Phrases by kind, lower-cased, as substrings of a line.
PHRASES = {
    "error": [
        "page not found", "not found", "access denied", "is denied", "access to this resource", "permission denied", "service unavailable", "gateway timeout", "gateway time-out", "bad gateway", "bad request", "internal error", "internal server error",
        "too many", "forbidden", "unauthorized", "session expired", "session has ended", "sign in again", "something went wrong", "an error occurred", "oops", "try later", "try again later", "you are not allowed to", "you do not have permission",
        "no longer on this server", "no longer available", "does not exist", "could not find", "could not be found", "may have moved", "unable to load", "connection refused", "down for maintenance", "did not respond", "timed out", "from your network", "from your ip address",
        "error 4", "error 5", "traceback (most recent call last)", "timeouterror", "keyerror", "valueerror", "typeerror", "runtimeerror", "ioerror", "oserror", "indexerror", "exception:",
        '"error":', "stack trace", "request could not be", "temporarily unavailable", "verify you are human", "verify that you are human", "not a robot", "captcha", "complete the captcha", "cookies are disabled", "enable cookies", "accept cookies to continue", "unusual traffic",
        "page introuvable", "accès refusé", "erreur interne", "erreur 4", "erreur 5", "momentanément indisponible", "n'existe plus sur ce serveur", "session a expiré", "reconnectez-vous", "trop de requêtes", "vous n'êtes pas un robot",
        "seite nicht gefunden", "zugriff verweigert", "interner fehler", "fehler 4", "fehler 5", "nicht erreichbar", "nicht mehr vorhanden", "sitzung ist abgelaufen", "zu viele anfragen", "erneut anmelden",
        "página no encontrada", "acceso denegado", "error interno", "no está disponible", "ya no está en este servidor", "su sesión ha caducado", "demasiadas solicitudes", "vuelva a entrar",
        "pagina non trovata", "accesso negato", "errore interno", "pagina richiesta non esiste", "sessione scaduta", "servizio non disponibile", "página não encontrada", "acesso negado", "erro interno", "sessão expirou",
        "nie znaleziono strony", "strona nie istnieje", "której szukasz", "nie istnieje", "odmowa dostępu", "brak dostępu", "błąd serwera", "pagina niet gevonden", "toegang geweigerd", "interne serverfout",
        "страница не найдена", "доступ запрещ", "ошибка сервера", "页面不存在", "找不到页面", "页面未找到", "已被删除", "访问被拒绝", "拒绝访问", "服务器错误", "ページが見つかりません", "お探しのページ", "アクセスが拒否", "サーバーエラー",
    ],
    "script": [
        *(f"{v} {n}" for vs, ns in _SCRIPT for v, n in product(vs, ns)),
        "checking your browser", "noscript mode", "nothing to show", "javascript is", "scripting is", "scripts are", "js is", "switched on", "works best with", "please enable", "please activate", "please turn on", "you must allow", "you must enable", "you need to enable", "your browser blocks", "to continue,", "please wait while", "before the viewer can", "without javascript", "does not support javascript", "javascript est", "javascript ist", "javascript está",
        "laden sie die seite neu", "seite neu laden", "recharger la page", "rechargez la page", "recargue la página", "to read this", "pour lire ce", "um dieses", "zu lesen", "para leer este", "and reload", "启用javascript", "启用 javascript", "javascriptを有効", "javascript を有効",
    ],
    "filler": [
        "lorem ipsum", "dolor sit amet", "blindtext", "hier steht text", "hier steht ihr text", "beispieltext", "platzhalter", "mustertext", "texte à venir", "texte d'exemple", "faux texte", "texto de ejemplo",
        "texto de relleno", "texto por venir", "texto de prueba", "aquí va el texto", "ici du texte", "text goes here", "content here", "sample text", "dummy text", "filler text", "placeholder text", "your text here", "text to come", "texte ici",
        "coming soon", "to be written", "(text)", "(texte)", "(texto)", "body copy", "text to follow", "copy goes here", "text folgt", "texto sigue", "testo segnaposto", "testo di esempio", "tekst zastępczy", "przykładowy tekst", "voorbeeldtekst", "texto de exemplo",
    ],
}
#: Lines that accompany residue and are no content of their own.
FURNITURE = re.compile(
    r"^(?:ref\.?\s*\d+|node\s*\d+|\d+\s*s|\(?\d+\)?|← .*|menu(?: \| .*)?|.*\| (?:login|index)\b.*|(?:home|index|manuals|start|inicio|accueil)\s*(?:>|›|»).*|https?://\S+|\W+|file \"[^\"]+\", line \d+.*|at \S+\(.*\)|[{\[].*[}\]])$",
    re.I,
)
#: Keyboard and mash words that filler is strung from.
KEYS = frozenset("asdf qwer qwerty jkl foo bar baz bla blah abc test xxx xxxx xxxxx yyy zzz hjkl yxcv qwertz".split())
#: The usual mock text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_WORD = re.compile(r"[^\W\d_]+")
STOPS = frozenset(w for ws in STOPWORDS.values() for w in ws)
_NAME = r"[^\W\d_][\w .'’-]{0,40}?"
_FILL = r"(?:insert|insérer|einfügen|insertar|insérez|inserte|your|votre|ihr|su|enter|add)"
_DONE = r"(?:to be completed|to be filled|à compléter|zu ergänzen|por completar|a completar|auszufüllen|noch ausfüllen|noch einzutragen|fill in|to fill in|à remplir|por rellenar|rellenar)"
#: What may fill the place of a value, brackets of template languages around a name: (notation, whether it has no other use).
NOTATION = [
    (rf"\{{\{{\s*(?P<n>{_NAME})\s*\}}\}}", True), (r"<%=?\s*(?P<n>[^%\n]{1,60}?)\s*%>", True), (r"<\?=?\s*(?P<n>[^?\n]{1,60}?)\s*\?>", True), (rf"%%(?P<n>{_NAME})%%", True), (rf"@@(?P<n>{_NAME})@@", True), (rf"<<\s*(?P<n>{_NAME})\s*>>", True),
    (rf"(?i:[<\[]{_FILL}\s(?P<n>[^>\]\n]{{1,40}})[>\]])", True), (rf"(?i:\({_DONE}\s*:?(?P<n>[^)\n]{{0,40}})\))", True), (r"(?<![^\s(])\{(?P<n>\d)\}(?![^\s.,;:)])", True),
    (r"\{%\s*(?:\w+\s+)?(?P<n>[^%\s]{1,60})\s*%\}", False), (rf"\$\{{\s*(?P<n>{_NAME})\s*\}}", False), (rf"#\{{\s*(?P<n>{_NAME})\s*\}}", False), (rf"\$\(\s*(?P<n>{_NAME})\s*\)", False), (rf"%\((?P<n>{_NAME})\)[sd]", False), (r"__(?P<n>[^\W\da-z_][^\Wa-z]*?)__", False),
    (rf"\[\[\s*(?P<n>{_NAME})\s*\]\]", False), (rf"&lt;\s*(?P<n>{_NAME})\s*&gt;", False), (r"\{(?P<n>[^\W\d]\w{1,40})\}", False), (r"\[(?:…|\.\.\.)(?P<n>[^\]\n]{1,40}?)(?:…|\.\.\.)\]", False), (r"«(?P<n>[^\W\d_]+(?:_[^\W\d_]+)*)»", False),
    (r"\|(?P<n>[A-ZÀ-Þ]+(?:_[A-ZÀ-Þ]+)*)\|", False), (r"\[(?P<n>[A-ZÀ-Þ]{2,}(?:[ _][A-ZÀ-Þ]+){0,4})\]", False), (r"<(?P<n>[A-ZÀ-Þ]{2,}(?:[ _][A-ZÀ-Þ]+){0,4})>", False),
]
_FORMS = [(re.compile(p), sure) for p, sure in NOTATION]
_OPENS = re.compile(r"[\[{<$%#@|«&]|__|\((?i:" + _DONE + ")")
#: A line of a program, and what surrounds a placeholder that belongs to one.
CODE = re.compile(
    r"^\s*(?:#!|//|/\*|>>> |\$ |def |class |import |from \w+ import|return\b|(?:if|for|while|with|else|try|elif)\b.*:$|echo |export |sudo |cd |let |var |const |function\b|public |private |#include|@\w+$|FROM |RUN |SELECT |print\()|[;{]$|\w\(\)|[=!<>]=|^\s*[\w.]+\s*\+?=\s*\S|\bexport \w+=|->|::|=>|```"
)
_BESIDE = re.compile(r"[\w/`'\"=:\\]$")
_AFTER = re.compile(r"^(?:[/`'\"\\:=]\S|\s+-{1,2}\w)")
#: Words of sentences about templates, programs and keys.
ABOUT = re.compile(
    r"\b(?:templates?|templating|placeholders?|variables?|macros?|syntax|jinja|shell|makefiles?|compilers?|compiles?|python|javascript|html|xml|regex|platzhaltern?|vorlagen?|variablen?|gabarits?|plantillas?|marcador(?:es)?)\b|(?:press(?:es|ed)?|hit|key|taste|touche|tecla|pulse|appuyez sur) ?\0",
    re.I,
)
_STRONG = re.compile(r"\b(?:templates?|templating|placeholders?|variables?|macros?|syntax|jinja|makefiles?|compilers?|platzhaltern?|vorlagen?|plantillas?|gabarits?)\b", re.I)
#: A field of a form whose value is a blank, dots or a note to fill it.
BLANK_FIELD = re.compile(r"^[^\W\d_][^:\n]{0,40}:\s*(?:_{3,}|\.{4,}|…{2,}|TODO|TBD|TBC|X{3,}|\?{2,}|N\.N\.|-{3,}|\[\s*\]|n/?a)\s*$", re.I | re.M)
_HTML_NOISE = re.compile(r"</?(?:html|body|h\d|p|div|noscript|title|head|span|br|center|hr)\b[^<>]*>", re.I)
_LINES = re.compile(r"\n+|(?<=[.!?。！？])\s+|(?<=[。！？])")


def _union(spans: list[tuple]) -> int:
    """Characters that spans cover together."""
    total = end = 0
    for a, b, _ in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def field(name: str) -> str:
    """A field's name without case, blanks and marks."""
    return "".join(_WORD.findall(name.lower()))


def placeholders(text: str) -> Iterator[tuple[int, str, bool]]:
    """Notation, field and sureness of the placeholders in ``text`` that stand where a value belongs."""
    if not _OPENS.search(text):
        return
    lines = [x for x in text.split("\n") if x.strip()]
    if sum(bool(CODE.search(x)) for x in lines) >= 0.3 * len(lines):
        return  # a program
    for i, (form, sure) in enumerate(_FORMS):
        for m in form.finditer(text):
            a, b = m.span()
            start, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
            line = text[start : end if end >= 0 else len(text)]
            sentence = re.split(r"(?<=[.!?])\s", text[start:a])[-1] + "\0" + re.split(r"(?<=[.!?])\s", text[b : end if end >= 0 else len(text)])[0]
            if CODE.search(line.replace(m[0], "")) or _BESIDE.search(text[max(0, a - 1) : a]) and not (a and text[a - 1] == ":") or _AFTER.match(text[b : b + 4]) or ABOUT.search(sentence) or _STRONG.search(line):
                continue
            yield i, field(m["n"]) or m["n"].strip(), sure


def made_up(ws: list[str], units: frozenset[str] = frozenset()) -> tuple[float, set[str]]:
    """Of the different words of a text, the share of letters in groups of three that recur in three of them (or that are in
    ``units``), and these groups.  Words of speech share endings, not most of their letters."""
    types = {w for w in ws if len(w) > 3}
    seen = Counter(g for w in types for g in {w[i : i + 3] for i in range(len(w) - 2)})
    again = {g for g, n in seen.items() if n >= 3}
    use, total, hit = again | units, 0, 0
    for w in types:
        mark = bytearray(len(w))
        for i in range(len(w) - 2):
            if w[i : i + 3] in use:
                mark[i : i + 3] = b"\1\1\1"
        total += len(w)
        hit += sum(mark)
    return (hit / total if total and sum(map(len, types)) >= 4.5 * len(types) else 0.0), again


class Learned(NamedTuple):
    """``names``: fields of templates; ``words``: of mock text; ``units``: letter groups of made-up words."""

    names: frozenset[str] = frozenset()
    words: frozenset[str] = frozenset()
    units: frozenset[str] = frozenset()


def spoken(low: str) -> bool:
    ws = low.split()
    return sum(map(STOPS.__contains__, ws)) >= SPOKEN * len(ws)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of what :class:`Learned` is made from: (kind, key, notation, n)."""
    n: Counter[tuple[str, str, int]] = Counter()
    for b in batches:
        for text in b[0].to_pylist():
            if not text:
                continue
            for i, name, _ in placeholders(text):
                n["name", name, i] += 1
                n["names", "", 0] += 1
            low = text.lower()
            if spoken(low) and "lorem" not in low:
                continue
            ws = _WORD.findall(low)
            if "lorem" in low:
                for line in _LINES.split(low):
                    found = _WORD.findall(line)
                    if len(found) >= 3 and not any(w in STOPS and w not in LOREM for w in found):
                        n["words", "", 0] += len(found)
                        for w in found:
                            n["word", w, 0] += 1
            elif len(ws) >= 30:
                share, again = made_up(ws)
                if share >= MADE_UP:
                    n["units", "", 0] += 1
                    for g in again:
                        n["unit", g, 0] += 1
        if len(n) > 200_000:
            yield _counts(n)
            n.clear()
    yield _counts(n)


def _counts(n: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array([k[2] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["kind", "key", "notation", "n"])


def learn(documents: DataFrame) -> Learned:
    """What the column ``text`` of all documents teaches; empty for a table without residue."""
    counts = cut(documents.select(F.col("text").cast("string")).mapInArrow(_scan, "kind string, key string, notation int, n long"), "residue")
    total = {r["kind"]: r["n"] for r in counts.where("kind in ('names', 'words', 'units')").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    per = counts.where("kind in ('name', 'word', 'unit')").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.count_distinct("notation").alias("notations"))
    least = {"name": NAME_SHARE * total.get("names", 0), "word": WORD_SHARE * total.get("words", 0), "unit": UNIT_SHARE * total.get("units", 0)}
    enough = F.coalesce(*[F.when(F.col("kind") == k, F.col("n") >= v) for k, v in least.items()])
    # bounded by the least shares
    rows = per.where(enough & ((F.col("kind") != "name") | (F.col("notations") >= NOTATIONS))).select("kind", "key").collect()
    return Learned(*(frozenset(r["key"] for r in rows if r["kind"] == k) for k in ("name", "word", "unit")))


class Detector:
    def __init__(self, coverage: float = COVERAGE, learned: Learned = Learned()) -> None:
        self.coverage, self.learned = coverage, learned
        self.mock = LOREM | learned.words
        self.phrases = Phrases((p, kind) for kind, ps in PHRASES.items() for p in ps)

    def residue(self, text: str | None) -> str | None:
        """The kind of residue: placeholder, error, script or filler; None for content and for empty texts."""
        if not text or not text.strip():
            return None
        if any(sure or name in self.learned.names for _, name, sure in placeholders(text)):
            return "placeholder"
        low = text.lower().replace("’", "'")
        if spoken(low) and low not in self.phrases and not BLANK_FIELD.search(text):
            return None
        lines = [x.strip() for x in _LINES.split(_HTML_NOISE.sub("\n", text)) if x and x.strip()]
        weight, total, fields, stops = dict.fromkeys(PHRASES, 0), 0, 0, 0
        rest: list[str] = []
        for line in lines:
            low = line.lower().replace("’", "'")
            ws = _WORD.findall(low)
            n = max(1, sum(map(len, ws)))
            spans = self.phrases.spans(low)
            kinds = defaultdict(int)
            if _union(spans) >= LINE_COVERAGE * len(line):
                for a, b, v in spans:
                    kinds[v] += b - a
            if BLANK_FIELD.match(line):
                fields += 1
            if kinds:
                weight[max(sorted(kinds), key=kinds.get)] += n
                total += n
            elif not ws and re.fullmatch(r"[.…\-–—_?*\s]+", line):
                stops += 1
            elif FURNITURE.match(line) or len(ws) <= 2 and (not ws or len(ws[0]) <= 1 or line.isupper()):
                continue
            elif ws and sum(w in KEYS for w in ws) >= 0.8 * len(ws) or ws and all(len(set(w)) == 1 for w in ws):
                weight["filler"] += n
                total += n
            elif len(ws) >= 2 and sum(w in self.mock for w in ws) >= 0.7 * len(ws):
                weight["filler"] += n
                total += n
            elif len(lines) > 1 and len(ws) <= 3 and line[-1] not in ".;!?":
                continue  # a heading
            else:
                total += n
                if not any(w in STOPS and w not in self.learned.units and len(w) > 2 for w in ws):
                    rest += ws
        if fields and fields >= 0.5 * len(lines):
            return "placeholder"
        if len(rest) >= 12:
            share, learned = made_up(rest)[0], made_up(rest, self.learned.units)[0] if self.learned.units else 0.0
            if share >= MADE_UP or learned >= MADE_UP_LEARNED:
                weight["filler"] += sum(map(len, rest))
        if total == 0 and stops:
            return "filler"  # headings over dots or dashes
        if total == 0:
            return "error" if re.search(r"[{\"]error|\b(?:4\d\d|50\d)\b", text, re.I) and len(text) < 200 else None
        kind = max(weight, key=weight.get)
        return kind if sum(weight.values()) >= self.coverage * total else None


def template_residue(documents: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents (doc_id BIGINT, text STRING) that hold residue instead of content: doc_id, kind.

    Each whole text is judged, with what all texts together teach.  Null, blank and empty texts are not residue; rows with a null id
    are judged too; repeated rows come out repeated; extra columns are ignored; an empty table gives none.
    A text at exactly ``coverage`` is residue.
    """

    learned = documents.sparkSession.sparkContext.broadcast(learn(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Detector(coverage, learned.value)
        for b in batches:
            out = [d.residue(t) for t in b[1].to_pylist()]
            keep = pa.array([i for i, k in enumerate(out) if k], pa.int64())
            yield pa.RecordBatch.from_arrays([b[0].take(keep), pa.array([k for k in out if k], pa.string())], names=["doc_id", "kind"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, kind string")


def without_residue(documents: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``documents`` without those that :func:`template_residue` finds; rows with a null doc_id stay."""
    return documents.join(template_residue(documents, coverage).select("doc_id").distinct(), "doc_id", "left_anti")
