"""Template residue, filler, error messages and script notices in place of real text.

Numbers, addresses and dates of every text are masked, and the text is cut into lines and sentences. Every segment
is counted by the hash of its masked form over all documents and sources. What recurs widely is classified once a
hash by the placeholder and phrase rules and those for messages; what stands in few documents is residue only by the
placeholder and phrase rules, which hold for a single case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .filters import bit_filter, passing

if TYPE_CHECKING:
    import pandas as pd

# Notations of unfilled slots.
SLOTS = (
    r"\{\{[^{}\n]{1,60}\}\}", r"[$#]\{[\w.#]+\}", r"<%=?[^%>\n]{1,60}%>", r"\{%[^%}\n]{1,60}%\}", r"@@[\w#]+@@", r"%\(\w+\)[sdf]",
    r"%[A-Za-z][A-Za-z_]+%", r"(?<![\w%])%[sd]\b", r"(?<!\{)\{[a-z]+(?:_[a-z]+)*\}(?!\})", r"\{#?(?::[^{}\s]{1,8})?\}", r"\[\[[^\[\]\n]{1,40}\]\]",
    r"<<[A-Z][A-Z_]*>>", r"\[[A-Z]{3,}(?: [A-Z]+)*\]?", r"__[A-Z]{3,}__", r"\bXX+\.X+\b", r"\bX{3,}\b", r"</?[a-z]+(?:[ -][a-z]+){0,4} ?/?>",
    r"&lt;[a-z]+(?:[ -][a-z]+){0,4}&gt;", r"\[object Object\]", r"\b(?:TODO|TBD|TBA|FIXME)\b",
    r"(?i:\[(?:citation needed|your|insert|inserte|insérez|insérer|hier|add|enter|placeholder|name|title|abstract)\b[^\]\n]{0,60}\])",
)
# Words before a slot's notation that make it a thing talked about.
NAMED = (
    "slot", "variable", "field", "placeholder", "parameter", "marker", "tag", "of the form", "format string", "string", "marked", "syntax,?", "notation",
    "sets as", "set as", "macros?", "feld", "platzhalter", "variablen?", "form", "champ", "balise", "gabarit", "campo", "marcador", "etiqueta",
)
# Residue beyond doubt, in masked lower case (# for numbers, @ for addresses).
PHRASES = (
    # filler
    r"\blorem ipsum\b(?! (?:is|was|are|as|text|filler|est|ist|es|and)\b)", r"\b(?:dummy|filler|placeholder|sample|blind) ?(?:copy|text|paragraph)\b(?: that| only|[.!]|$)",
    r"^(?:dummy|sample|blind) (?:text|paragraph|copy)\b", r"^(?:\W*(?:null|undefined|nan|none|n/a)\b\W*){2,}$", r"^(?:title|titel|titre|título|authors?|autoren|auteurs|autores|abstract|keywords) ?: ?(?:to be added|tbd|tba|n/a|xxx*|\?+)?$",
    r"\bto be added\b *\.?$", r"^(?:abstract|summary|keywords|zusammenfassung|résumé|resumen) ?\((?:max|min|#)", r"\b(?:replace|overwrite) this (?:text|paragraph|line)\b",
    r"\bhier einfügen\b", r"\bà compléter\b", r"\b(?:insert|enter|add|write) (?:your |the )?(?:own )?(?:abstract|summary|title|text|keywords) here\b",
    # scripts and browsers
    r"(?:^|please |, )(?:enable|activate|allow|turn on|switch on)\b.{0,30}\b(?:javascript|scripts|cookies)\b", r"\b(?:have|need) to (?:enable|allow|activate|turn on)\b.{0,20}\b(?:javascript|scripts|cookies)\b",
    r"\b(?:needs|requires) javascript\b *\.?$", r"\bscripts are (?:switched off|blocked|disabled)\b", r"\bturn it on and reload\b", r"\b(?:aktivieren sie|activez|activer|active|habilite)\b.{0,12}\bjavascript\b",
    r"\bskripte sind (?:gesperrt|deaktiviert|blockiert)\b", r"\bscripts sont (?:bloqués|désactivés)\b", r"\b(?:guiones|scripts) están (?:bloqueados|desactivados)\b", r"^checking your browser\b",
    # errors
    r"\bservice (?:is )?(?:temporarily )?unavailable\b *[:.;,!]?(?:$| *planned| *please| *try)", r"^planned maintenance\b", r"\bfailed to load\b *[.!]?$", r"\btoo many requests\b.{0,30}\baddress\b", r"\bsomething went wrong\b", r"^(?:please )?try again later\b",
    r"\byou (?:do not|don't) have (?:permission|access)\b", r"\bsign in again\b", r"^your session (?:has|is)\b", r"\bwe (?:cannot|can't|could not) find the page\b", r"^oops\b", r"^(?:http )?(?:error )?# (?:error|not found|forbidden|bad gateway)\b",
    r"\bis not on this server\b", r"\bdid not answer in time\b", r"^traceback\b", r"\b(?:key|value|type|index|attribute|name)error at line\b", r"\bwhile rendering @",
    r"\b(?:access|permission) denied\b *[.(:!]", r"\bpage (?:was )?not found\b *[.!]?$", r"^erreur # ?:", r"\bpage demandée est introuvable\b", r"\ba été retirée? du serveur\b", r"\bsession a expiré\b", r"\b(?:accès refusé|acceso denegado|zugriff verweigert|zugang verweigert)\b",
    r"\bmomentanément indisponible\b", r"\bwegen wartung\b", r"\bkonnte nicht geladen werden\b", r"\bsitzung ist abgelaufen\b", r"^die seite @? ?.{0,30}wurde nicht gefunden\b", r"\bservicio no disponible\b", r"\bsesión ha caducado\b",
    r"\bno se pudo cargar\b", r"\bno se encontró (?:el archivo|la página)\b", r"^fehler # ?:", r"^error # ?:",
)
# What a message that recurs widely must mention.
CUES = (
    "javascript", "cookies?", "browser", "navegador", "navigateur", "server", "serveur", "servidor", "(?:session|sesión|sitzung) (?:has|is|was|ist|wurde|a|ha) ?(?:been |already )?(?:expired|ended|closed|over|abgelaufen|beendet|expiré|caducado|terminado)", "log ?in", "sign in", "permission", "unavailable", "maintenance", "wartung",
    "mantenimiento", "reload", "neu laden", "reconnectez", "vuelva a entrar", "réessayez", "inténtelo", "retry", "denied", "forbidden", "not found", "introuvable", "nicht gefunden", "timed? out", "captcha", "robot",
    r"\(code #\)", "ref #",
)
# Other forms of notices, for what recurs widely only: requests, codes, words to the reader, failures.
NOTICES = (
    r"^(?:please|sorry|bitte|veuillez|por favor|désolé|lo sentimos|leider)\b", r"^(?:click|tap|press|refresh|wait|loading|subscribe|cliquez|klicken sie|haga clic|warten sie|attendez|espere|cargando|chargement)\b",
    r"^(?:incident|request|support|trace)(?: id| no\.?| number| code)?\W*#\W*$", r"\b(?:try|come|check) (?:it )?(?:again|back) (?:later|soon|in #)",
    r"\b(?:you|your|yours|vous|votre|vos|usted|ustedes)\b", r"\b(?:können|müssen|haben|werden|dürfen|sollten|möchten|ihnen|ihrem|ihren|ihr) sie\b", r"\bihre?[nm]? (?:abonnement|browser|gerät|konto|passwort|zugang|zugriff)\b", r"\bsu (?:acceso|conexión|cuenta|dispositivo|suscripción)\b",
    r"\b(?:having|had|ran into) (?:some )?(?:trouble|problems)\b", r"^(?:http |error )?#:? (?:[\w-]+ ){0,3}(?:error|failed|failure|forbidden|gateway|timeout|unauthorized|unavailable)\b", r"^(?:bad gateway|gateway time-?out|internal server error|connection (?:refused|reset|timed out))\b", r"\b(?:fetch|request|loading|upload|download) failed\b *[.!]?$",
    r"\b(?:can(?:not|'t| not)|could not|couldn't|unable to) (?:be )?(?:connect|display|displayed|load|loaded|open|opened|reach|reached|show|shown)\b",
)
# Sentences that report on such messages.
TALK = (
    r"\bwe (?:study|write|count|counted|removed|report|found|discuss)\b", r"\b(?:were|was|are) (?:told|counted|removed|logged|parsed|dropped|excluded|asked)\b", r"\bcounts? as\b", r"\bsuch as\b", r"\b(?:pages|viewers?|sites|papers) (?:that|which)\b",
    r"\bles pages qui\b", r"\bont été\b", r"\bse contaron\b", r"\bseiten, die\b", r"\bfehlen in\b", r"\bfueron\b", r"\bwurden\b", r"\bis a known\b", r"\bis returned when\b", r"\bknown artefact\b",
)

# Every phrase and cue holds one of these in lower case; looked for before the patterns, as plain strings.
TRIGGERS = (
    "lorem", "dummy", "filler", "placeholder", "sample ", "blind ", "null", "undefined", "nan", "none", "n/a", "tbd", "tba", "xxx", "to be added", "abstract", "summary", "keywords", "zusammenfassung", "résumé", "resumen",
    "title", "titel", "titre", "título", "author", "autor", "auteur", "replace this", "overwrite this", "einfügen", "compléter", " here", "javascript", "scripts", "cookie", "skripte", "guiones", "turn it on", "checking your browser", "browser",
    "unavailable", "maintenance", "mantenimiento", "wartung", "failed to load", "too many requests", "went wrong", "try again", "permission", "have access", "sign in", "log in", "login", "session", "sesión", "sitzung", "find the page", "oops",
    "error", "erreur", "fehler", "not found", "forbidden", "bad gateway", "server", "serveur", "servidor", "in time", "timed out", "time out", "traceback", "while rendering", "denied", "introuvable", "retiré", "refusé", "denegado", "verweigert", "indisponible",
    "geladen", "gefunden", "no disponible", "caducado", "no se pudo", "no se encontró", "navega", "navigateur", "reload", "neu laden", "reconnectez", "vuelva a entrar", "réessayez", "inténtelo", "retry", "captcha", "robot", "(code ", "ref ",
)


def _any(patterns: tuple[str, ...]) -> str:
    return "(?:" + "|".join(patterns) + ")"


_SPLIT = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
_ADDRESS = re.compile(r"\b(?:https?://|www\.)\S+|(?<!\S)[^\s@]+@[^\s@]+\.\w+|(?<![^\s\"'(])/[\w./-]+")
_NUMBER = re.compile(r"\b(?=[a-f]{0,40}\d)[0-9a-f]{7,}\b|\d+(?:[.,:/-]\d+)*")
_SIGNS = re.compile(r"[{}<>$%\[_]|@@|&lt;|XX|TODO|TB[DA]|FIXME")
_SLOT = re.compile(_any(SLOTS))
# a slot that is named right before it is talked about; it goes before slots are looked for
_NAMED_SLOT = re.compile(r"(?i:\b" + _any(NAMED) + r")\s+[\"'“„«`]?" + _any(SLOTS))
_PHRASE, _TALK, _CUE, _NOTICE = (re.compile(p) for p in (_any(PHRASES), _any(TALK), r"\b" + _any(CUES), _any(NOTICES)))
#: What a segment is: residue by itself, a message if it recurs widely, neither.
SURE, MESSAGE, TEXT = 2, 1, 0


@lru_cache(maxsize=1)
def _triggers():  # noqa: ANN202
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in TRIGGERS:
        found.add_word(t, t)
    found.make_automaton()
    return found


def _touched(low: str) -> bool:
    return next(_triggers().iter(low), None) is not None


def masked(text: str) -> str:
    """The text with addresses as @, numbers, dates and long hexadecimal ids as #."""
    if "@" in text or "/" in text or "www." in text:
        text = _ADDRESS.sub("@", text)
    return _NUMBER.sub("#", text)


def sure(m: str) -> bool:
    """Whether a masked segment is residue by itself."""
    low = m.lower()
    if _SIGNS.search(m) and _SLOT.search(m) and _SLOT.search(_NAMED_SLOT.sub(" ", m)):
        return True
    words = low.split()
    if len(words) >= 6 and len(set(words)) <= 3:
        return True
    return bool(_touched(low) and _PHRASE.search(low) and not _TALK.search(low))


def classified(m: str) -> int:
    """SURE, MESSAGE or TEXT for a masked segment."""
    if sure(m):
        return SURE
    low = m.lower()
    return MESSAGE if (_CUE.search(low) or _NOTICE.search(low)) and not _TALK.search(low) else TEXT


@dataclass(frozen=True)
class Recurrence:
    """A segment recurs widely in so many documents of two sources or more, or in `alone` documents of one source."""

    documents: int = 3
    alone: int = 10


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(k, src, h, m, sure) of every different segment of every row: its masked form and that form's hash, whatever
    its length, the source's hash, and whether it is residue by itself."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            k, src, h, own, flags = [], [], [], [], []
            for key_, text_, source_ in zip(b["k"], b["t"], b["s"]):
                whole = masked(text_)
                # most texts show no sign of the rules at all
                odd = bool(_SIGNS.search(whole)) or _touched(whole.lower())
                seen = set()
                for segment in _SPLIT.split(whole):
                    words = segment.split()
                    if words:
                        m = " ".join(words)
                        if m not in seen:
                            seen.add(m)
                            own.append(m)
                            h.append(digest(m) - (1 << 63))
                            flags.append((odd or (len(words) >= 6 and len({w.lower() for w in words}) <= 3)) and sure(m))
                k += [key_] * len(seen)
                src += [digest(source_ or "") - (1 << 63) if source_ is not None else 0] * len(seen)
            if k:  # an empty frame has no types
                yield pd.DataFrame({"k": pd.array(k, dtype=b["k"].dtype) if b["k"].dtype != object else k, "src": src, "h": h, "m": own, "sure": flags})

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("s")).where(F.col("k").isNotNull() & (F.length("t") > 0))
    return rows.mapInPandas(read, f"k {dict(docs.dtypes)[key]}, src bigint, h bigint, m string, sure boolean")


def recurring(found: DataFrame, widely: Recurrence) -> DataFrame:
    """(k, h, m) of the segments that recur widely.

    One shuffle of numbers, combined in the tasks first, so that a segment which a third of all documents hold is a
    row a task; the least and the greatest source tell whether there are two. Texts of other segments stay where they
    are, but for those that pass a filter of fixed size.
    """
    by = found.groupBy("h").agg(F.count("*").alias("n"), F.min("src").alias("low"), F.max("src").alias("high"))
    wide = by.where(((F.col("n") >= widely.documents) & (F.col("low") < F.col("high"))) | (F.col("n") >= widely.alone)).select("h")
    wide = materialise(wide)
    bits = found.sparkSession.sparkContext.broadcast(bit_filter(wide))

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[passing(bits.value, b["h"].to_numpy(np.int64))]

    rows = found.select("k", "h", "m")
    return rows.mapInPandas(some, rows.schema).join(wide, "h", "left_semi")


def messages(wide: DataFrame) -> DataFrame:
    """(h): the widely recurring segments that are residue or messages; every hash is classified once."""

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[classified(m) != TEXT for m in b["m"]], ["h"]]

    return wide.groupBy("h").agg(F.min("m").alias("m")).mapInPandas(classify, "h bigint")


def evidence(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", widely: Recurrence = Recurrence()) -> DataFrame:
    """(key, recurring, single) of every document with a residue: whether one recurs widely, and whether one is
    residue by itself.

    Whole texts are read. Null and empty texts and null keys have no residue; a null source is a source; repeated
    rows count as often as they occur; other columns are not read.
    """
    found = materialise(segments(docs, key, text, source))  # read three times below
    wide = materialise(recurring(found, widely))
    said = wide.join(messages(wide), "h", "left_semi").select("k", F.lit(True).alias("recurring"), F.lit(False).alias("single"))
    alone = found.where("sure").select("k", F.lit(False).alias("recurring"), F.lit(True).alias("single"))
    return said.unionByName(alone).groupBy("k").agg(F.max("recurring").alias("recurring"), F.max("single").alias("single")).withColumnRenamed("k", key)


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", widely: Recurrence = Recurrence()) -> DataFrame:
    """(key): every document with at least one residue, once; cases as for evidence()."""
    return evidence(docs, key, text, source, widely).select(key)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents without residue; rows with a null key stay, as nothing can exclude them."""
    return docs.join(residue(docs, key, text, source), key, "left_anti")
