"""Personal information in free text, found by anchor expansion and replaced by typed placeholders.

One Aho-Corasick automaton finds the anchors of a text in a single pass: at-signs and their spellings,
identifier labels, street words, titles, and classes of phrases beside which people are named (thanks, commit
trailers, keys of records, salutations, recipients and owners, verbs of saying and of dwelling), also with one
typing error. At each anchor a deterministic local parser expands to the boundaries of the mention, however far
they are, and validates it; what only looks alike (remotes, pinned packages, order numbers, ranges, components named after someone) fails the
validation. Numbers have no fixed anchor characters, so runs of digits are found by one regular expression
and parsed by the numbering plans. Names in other sentences are found by their own form: capitalised words
that begin with a given name or an initial, or that stand beside an email address or a phone number.

Texts are matched whole, row by row, with no shuffle. The lexicon of phrases is a parameter.

Defined results: null and empty texts have no mentions and stay as they are; a mention is reported once,
overlaps go to the kind named first of email, id_number, phone, address, name; positions count Unicode
characters, also outside the basic plane; repeated rows give repeated mentions; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KINDS = ("email", "id_number", "phone", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "address": "[ADDRESS]", "name": "[NAME]"}

# --- email ---------------------------------------------------------------------------------------------

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9+])?"
_AT = r"(?:\s?@\s?|\s?[\(\[]\s?at\s?[\)\]]\s?)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\(\[]\s?dot\s?[\)\]]\s?)"
_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+@/:-])(?:mailto:)?(?P<m>{_LOCAL}{_AT}(?:{_LABEL}{_DOT})+[A-Za-z]{{2,}}"
    rf"|{_LOCAL}(?:\sdot\s{_LOCAL})*\sat\s(?:{_LABEL}\sdot\s)+[A-Za-z]{{2,}})(?![A-Za-z0-9@])",
    re.IGNORECASE,
)
_NOT_MAIL_AFTER = re.compile(r"(?::(?!\s)[\w./~-]|/[\w.])")


_INNER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _back_over(text: str, at: int) -> int:
    """Where the stretch of address characters that ends at `at` begins, with parts spelt with "dot" before it."""
    while True:
        while at and text[at - 1] in _INNER:
            at -= 1
        if at > 5 and text[at - 5 : at].lower() == " dot " and text[at - 6] in _INNER:
            at -= 5
        else:
            return at


def _emails(text: str, pos: int, found: list) -> None:
    """The address around an anchor: expanded to both ends, however far they are, then validated as a whole."""
    at = pos
    if text[pos : pos + 5].lower() == " dot ":  # spelt out: back over the domain to " at "
        at = _back_over(text, pos)
        if text[at - 4 : at].lower() != " at ":
            return
        at -= 4
    while at and text[at - 1] in " ([" and pos - at < 4:
        at -= 1
    start = _back_over(text, at)
    if text[max(0, start - 7) : start].lower() == "mailto:":
        start -= 7
    while start < at and not text[start].isalnum():
        start += 1
    m = _EMAIL.match(text, start)
    if not m or m.end() <= pos or _NOT_MAIL_AFTER.match(text, m.end()) or text.endswith("://", 0, m.start("m")):
        return
    found.append((m.start("m"), m.end("m"), "email"))


# --- numbers -------------------------------------------------------------------------------------------

_EXT = r"(?:[ ,]{0,2}(?:ext\.?|extension|x|durchw(?:ahl|\.)|poste|anexo|分机)[ .]?\d{1,6})?"
_PLANS = [
    r"(?:\+|00)\d{1,3}(?:[ .\-/]?\(0\))?(?:[ .\-/]?\(?\d{1,5}\)?){1,6}",  # with country prefix
    r"(?:\+?1[ .\-]?)?(?:\([2-9]\d{2}\)[ .\-]?|[2-9]\d{2}[ .\-])\d{3}[ .\-]\d{4}",  # ten digits in 3-3-4
    r"0[1-9](?:[ .\-]\d{2}){4}",  # pairs
    r"\(0\d{1,4}\)[ /\-]?\d{3,8}(?:[ \-]\d{1,6}){0,2}",  # area code in brackets
    r"0\d{2,4}[ /\-]\d{3,8}(?:[ \-]\d{1,6}){0,2}",  # area code with trunk 0
]
_PHONE = re.compile(rf"(?<![\w.\-/@#:+])(?:{'|'.join(_PLANS)}){_EXT}(?![\w@])(?!\.\d)(?!-\d)", re.IGNORECASE | re.ASCII)
_DIGITS = re.compile(r"[+(]?\d[\d ().\-/]{5,}\d", re.ASCII)

_ID_FORMS = [
    r"[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?",  # 13 or 15 digits
    r"\d{17}[\dXx]",
    r"\d{3}[- ]\d{2}[- ]\d{4}",
    r"\d{8}[- ]?[A-Za-z]",
    r"[XYZ][- ]?\d{7}(?:[- ]?[A-Za-z])?",
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]",
    r"[A-Z]{1,3} ?\d{6,8}[A-Z]?",
    r"[A-Z]\d{2}[A-Z]{2}\d{4}",
    r"\d{2} ?\d{3} ?\d{3} ?\d{3}",
    r"\d{3} ?\d{3} ?\d{3}",
    r"\d{2}[ /]?\d{3}[ /]?\d{5}",
    r"\d{8,12}",
]
_ID = re.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(_ID_FORMS)})(?![A-Za-z0-9_])(?!-\d)", re.ASCII)
_ID_GAP = re.compile(r"[^\n.!?。！？]{0,24}?(?=(?<![A-Za-z0-9_])(?:[A-Z]{1,3} ?\d|\d))")

_ID_NEAR = re.compile(r" [^\n\d.!?。！？,(<]{1,24}? (?=(?:[A-Z]{1,3} ?)?\d)")
_OTHER_NUMBER = re.compile(
    r"order|invoice|ticket|build|port|version|run|issue|line|row|page|shard|batch|job|pid|since|after|before|until|mobile|phone|tel\b|fax|call|handy|móvil|portable|bestell|rechnung|"
    r"pedido|factura|commande|facture|#|nr\.",
    re.IGNORECASE,
)

# --- addresses -----------------------------------------------------------------------------------------

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ]?[\w'’]+)*"
_GAP = r"(?:,? ?\r?\n[ \t]*|, ?| - | )"  # between the parts of an address
_EN = re.compile(
    rf"(?<![\w.#/-])\d{{1,5}}[A-Z]?(?:-\d{{1,5}})? (?:{_CAP} ){{1,3}}"
    r"(?:Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Drive|Dr\b\.?|Avenue|Ave\b\.?|Boulevard|Blvd\b\.?|Court|Ct\b\.?|Terrace|Close|Way|Place|Square|Row|Crescent)"
    rf"(?:{_GAP}(?:Apt\.?|Apartment|Unit|Suite|Ste\.?|Flat|Floor) ?#?\w{{1,5}}|{_GAP}#\w{{1,5}})?"
    rf"(?:(?:, ?|,? ?\r?\n[ \t]*){_CAP}(?: {_CAP})?(?=,? \d{{5}}\b))?(?:(?:, ?){_CAP}(?: (?![A-Z]{{1,2}}\d){_CAP})?(?:,? [A-Z]{{2}}\b)?)?(?:{_GAP}(?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}})\b)?"
)
_DE = re.compile(
    rf"(?<![\w-])[A-ZÄÖÜ][\wäöüß]*(?:straße|strasse|str\.|gasse|weg|platz|ufer|ring|allee|damm|steig|markt|graben) "
    rf"\d{{1,4}}(?: ?[a-z]\b)?(?: ?[-–] ?\d{{1,4}}(?: ?[a-z]\b)?)?(?:(?:{_GAP}| in |,? D-)\d{{5}} {_CAP}(?: (?:am|an der|im|bei) {_CAP})?)?"
)
_ES = re.compile(
    rf"(?<!\w)(?:Calle|C/|Avda\.?|Avenida|Av\.|Paseo|P\.º|Plaza|Pza\.?|Camino|Ronda|Travesía|Carrera|Cuesta|Glorieta) ?"
    rf"(?:(?:del|de la|de los|de las|de) )?{_CAP}(?: (?:del |de la |de )?{_CAP})*,? (?:n[º°o]\.? ?)?\d{{1,4}}"
    rf"(?:, ?(?:bajo(?: [A-Z]\b)?|ático|entlo\.?|\d{{1,2}}[º°ª](?: ?(?:izq\.?|dcha\.?|ctro\.?|[A-Z]\b))?))?(?:{_GAP}\d{{5}} {_CAP}(?: (?:del|de la|de) {_CAP})?)?"
)
_FR = re.compile(
    rf"(?<![\w-])\d{{1,4}}(?: (?:bis|ter|quater)\b)?,? (?:rue|bd|boulevard|avenue|av\.|quai|chemin|impasse|place|allée|cours|route|square|passage) "
    rf"(?:(?:des|du|de la|de l['’]|de|d['’]) ?)?{_CAP}(?: (?:{_CAP}))*(?:{_GAP}\d{{5}} {_CAP}(?: {_CAP})*)?",
)
_ZH = re.compile(
    r"(?:[一-鿿]{2,3}省)?(?:[一-鿿]{2}(?:市|县|镇|乡)|[一-鿿](?:城|州|镇))(?:[一-鿿]{2}[区县镇乡])?[一-鿿]{2,4}?(?:大道|路|街|巷|弄|胡同)"
    r"\d{1,5}号(?:院)?(?:\d{1,3}(?:栋|幢|号楼))?(?:\d{1,3}单元)?(?:\d{1,4}(?:室|楼|层))?"
)


def _word_starts(text: str, pos: int, words: int) -> list[int]:
    """Where the word at `pos` and the last `words` before it on its line begin, the farthest first."""
    out = []
    while len(out) <= words:
        while pos and not text[pos - 1].isspace():
            pos -= 1
        out.append(pos)
        while pos and text[pos - 1] in " \t":
            pos -= 1
        if not pos or text[pos - 1].isspace():
            break
    return out[::-1]


def _addresses(text: str, pos: int, form: re.Pattern, found: list) -> None:
    """The address around a street word: from one of the words before it to the last part given."""
    if form is _ZH:  # all parts before the number have bounded lengths
        m = form.search(text, max(0, pos - 40), pos + 40)
        while m and m.end() <= pos:
            m = form.search(text, m.end(), pos + 40)
        if m and m.start() <= pos:
            found.append((m.start(), m.end(), "address"))
        return
    for start in _word_starts(text, min(pos + 1, len(text)), 5):
        while start < pos and text[start] in "([{\"'“„«,;:":
            start += 1
        m = form.match(text, start)
        if m and m.start() <= pos < m.end():
            found.append((m.start(), m.end(), "address"))
            return


# --- names ---------------------------------------------------------------------------------------------

_W = r"[^\W\d_]+(?:['’][^\W\d_]+)?(?:-[^\W\d_]+)?"
_UP = rf"(?=[^\W\d_a-zß-öø-ÿ]){_W}"  # begins with a capital
_INI = r"[^\W\d_a-zß-öø-ÿ]\."
_WEST = rf"(?:{_INI} ?){{0,2}}{_UP}(?: (?:{_INI}|(?:de|von|van|del|la|le|bin) )?(?: ?{_UP})| {_INI}){{0,3}}"
_NAME = re.compile(rf"(?:{_UP}, {_UP}(?: {_INI})?(?=[,;:.<\(\"]| [^\W\d_A-ZÀ-Þ]|\s*$)|{_WEST})")
_LOWNAME = re.compile(rf"{_W}(?: {_W}){{0,2}}|{_W}, {_W}")
_HAN = r"[一-鿿]{2,3}"
_TITLE = re.compile(r"(?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme|Mlle|M)\.?|Frau|Herrn?|Señora?|Madame|Monsieur|Don|Doña) (?=\S)")


#: Phrases before a name, by what they are. After `SURE` ones single words and names in small letters count too; after
#: `LIKELY` ones two words, or a given name. Titles are `SURE` for capitals.
THANKS = ("thanks ", "thanks to ", "thank you ", "danke ", "danke an ", "gracias ", "gracias a ", "merci ", "merci à ", "cheers ")
TRAILERS = tuple(f"{w}: " for w in (
    "signed-off-by", "reviewed-by", "co-authored-by", "reported-by", "acked-by", "tested-by", "suggested-by", "helped-by", "author", "owner", "maintainer",
    "assignee", "reviewer", "contact", "ansprechpartner", "verantwortlich", "responsable", "autor", "auteur",
))
KEYS = tuple(f'"{k}":{gap}"' for k in ("owner", "name", "author", "assignee", "user", "contact", "full_name") for gap in ("", " "))
CONTACT = ("ping ", "reviewed with ", "paired with ", "bitte ", "pregunta a ", "pregunte a ", "demande à ", "demandez à ", "ask for ", "frag ", "fragen sie ")
TITLES = ("frau ", "herr ", "herrn ", "mr. ", "mrs. ", "ms. ", "dr. ", "sr. ", "sra. ", "mme ", "m. ", "prof. ", "señor ", "señora ", "madame ", "monsieur ", "mlle ")
LIKELY = (
    "ask ", "call ", "contact ", "reach ", "tell ", "email ", "notify ", "met ", "met with ", "spoke with ", "talked to ", "dear ", "hi ", "hello ", "hallo ", "hola ", "bonjour ",
    "liebe ", "lieber ", "estimado ", "estimada ", "cher ", "chère ", "regards, ", "regards,\n", "grüße, ", "saludos, ", "cordialement, ", "goes to ", "sent to ", "assigned to ",
    "belongs to ", "account of ", "behalf of ", "written by ", "reported by ", "approved by ", "fixed by ", "owned by ", "geht an ", "gehört ", "konto von ", "namen von ", "cuenta de ",
    "nombre de ", "va a ", "asignado a ", "llama a ", "llame a ", "escrito por ", "compte de ", "nom de ", "envoyé à ", "assigné à ", "appelez ", "contactez ", "écrit par ", "on-call is ",
    "this week is ",
)
SURE = THANKS + TRAILERS + KEYS + CONTACT
#: What stands after a name: verbs of saying and of dwelling, and what opens someone's contact details.
SAYING = (
    "said", "says", "wrote", "writes", "thinks", "thought", "noted", "asked", "replied", "reports", "suggests", "suggested", "explained", "mentioned", "confirmed",
    "meint", "sagt", "sagte", "schreibt", "fragt", "berichtet", "erklärt", "glaubt", "dice", "dijo", "escribe", "escribió", "pregunta", "comenta", "cree", "explica", "dit",
    "écrit", "pense", "explique", "propose",
)
DWELLING = ("moved", "lives", "wohnt", "zog", "vive", "se mudó", "habite", "a déménagé")
DETAILS = (" <", " (mobile", " (tel", " (phone", " (handy", " (móvil", " (portable", " (email")
AFTER = tuple(f" {v}{end}" for v in SAYING + DWELLING for end in (" ", ",", ":")) + DETAILS
#: What ends a name in small letters.
_ENDS = re.compile(
    r" ?[,.;:!?)\]\"<(]|\s*$|\r?\n| (?:and|at|on|in|via|about|for|from|before|after|still|has|is|was|will|und|unter|bei|fragen|anrufen|wegen|zum|zur|y|en|sobre|et|au|à|sur|pour|"
    + "|".join(SAYING + DWELLING)
    + r")\b"
)
#: The same for names in Han characters: what stands before or after them.
HAN_BEFORE = ("谢谢", "请联系", "联系人", "感谢", "负责人", "请找")
HAN_AFTER = ("说", "认为", "表示")
#: After these only a name that begins with a frequent surname counts.
HAN_DOING = ("今天", "昨天", "提交", "负责", "报告", "建议", "提到", "写道", "反馈", "修复", "住在", "搬到")

_BACK = re.compile(rf"(?:(?:{_INI} ?){{0,2}}{_W}(?: (?:{_INI}|{_W})){{0,3}}|{_W}, {_W}(?: {_INI})?|{_W} {_INI})$")
_BACK_UP = re.compile(rf"(?<![\w@.+-])(?:{_UP}, {_UP}(?: {_INI})?|(?:{_INI} ?){{0,2}}{_UP}(?: (?:{_INI}|{_UP})){{0,3}}|{_UP} {_INI})$")
#: In small letters, only whole: from the start of a line or sentence, a title or a colon to the phrase.
_BACK_LOW = re.compile(rf"(?:^|\n(?:[-*] )?|[.:。！] ?|\b(?:Mr|Mrs|Ms|Dr)\. |\b(?:Frau|Herr|[Tt]hanks) )({_W}(?:,? {_W})?)$")
_AND = re.compile(r" and | und | y | et ")
_TITLED = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme|Mlle|M)\.?|\bFrau|\bHerrn?|\bSeñora?|\bMadame|\bMonsieur) $")
_SMALL = frozenset(
    "the a an our your my their his her its this that these those each every some any all no it he she they we you i to of in on at by for with from as is are was were be been so if "
    "der die das den dem des ein eine einen einem einer uns euch sie er es wir ihr mein dein el la los las un una unos mi tu su le les une des du nos vos ce cette ces mon ton son "
    "and or but not now then there here when where who what why how everyone someone anyone nobody nothing nur nicht auch noch mir dich mich que de y o pero ou et mais pas".split()
)
_STARTS = re.compile(
    r"(?:The|A|An|Our|Each|Every|Whatever|This|That|It|He|She|They|We|You|Der|Die|Das|Ein|Eine|El|La|Los|Las|Un|Una|Le|Les|Une|On|Il|Elle|Note|Why|Escalation|Call|Ping|Mr|Mrs|Ms|Frau|Herr)$"
)


def _plain(name: str) -> bool:
    return not any(c.isdigit() or c == "_" for c in name)


def _name_after(text: str, pos: int, sure: bool | None, title: bool, found: list, again: bool = False) -> None:
    """The name behind a phrase."""
    t = _TITLE.match(text, pos)
    if t:
        pos, title = t.end(), True
    m = _NAME.match(text, pos)
    if m and not _STARTS.match(m.group().split()[0]):
        end = m.end()
        words = re.split(r",? ", text[pos:end])
        while len(words) > 1 and _no_name(words[-1]):  # the next sentence's first word
            end = text.rfind(" ", pos, end)
            end -= text[end - 1] == ","
            words.pop()
        if any(_no_name(w) for w in words) or (end < len(text) and text[end] == " " and _THING.match(text, end + 1)):
            return
        if not (sure or title) and (len(words) < 2 or sure is None) and not any(_bare(w) in GIVEN for w in words) and words[0][1:2] != ".":
            return  # after a misspelt phrase only with a given name or an initial
    else:
        m = _LOWNAME.match(text, pos)
        if m is None or not (sure or title or _bare(m.group().split()[0].rstrip(",")) in GIVEN):
            return
        end = pos  # up to the first word that something follows which ends a name
        for w in re.finditer(r"[^ ]+", m.group()):
            if _ENDS.match(text, pos + w.end()):
                end = pos + w.end()
                break
        words = text[pos:end].split(" ")
        if end <= pos or not text[pos:end].islower() or any(_no_name(w.rstrip(",")) or w in _SMALL for w in words):
            return
        if not title and len(words) < 2 and _bare(words[0]) not in GIVEN:
            return
    name = text[pos:end]
    if not _plain(name) or (end < len(text) and (text[end].isalnum() or text[end] == "_" or text[end : end + 1] == "-")):
        return
    found.append((pos, end, "name"))
    a = _AND.match(text, end)
    if a and not again:
        _name_after(text, a.end(), sure, title, found, True)


def _name_before(text: str, end: int, cue: str, found: list) -> None:
    """The name before a phrase."""
    lo = _word_starts(text, end, 5)[0]
    m = _BACK_UP.search(text, lo, end)
    if not m:
        if cue == " <":
            return
        m = _BACK_LOW.search(text, max(0, lo - 2), end)
        if not m or not m.group(1).islower():
            return
        words = re.split(r",? ", m.group(1))
        if any(w in _SMALL or _no_name(w) for w in words) or (len(words) < 2 and _bare(words[0]) not in GIVEN):
            return
        if _bare(words[0]) not in GIVEN and _bare(words[-1]) not in GIVEN:
            return
        found.append((m.start(1), end, "name"))
        return
    start = m.start()
    words = text[start:end].split(" ")
    while words and (_STARTS.match(words[0].rstrip(".,:")) or _TITLE.match(words[0] + " x") or (len(words) > 1 and words[0].lower() in _WORD)):
        start += len(words[0]) + 1
        words = words[1:]
    if text[end : end + len(cue)].strip().isupper() and not any(_bare(w.rstrip(",")) in GIVEN for w in words):
        return  # all in capitals
    if len(words) == 1 and (_no_name(words[0]) or (_bare(words[0]) not in GIVEN and not _TITLED.search(text, max(0, start - 12), start))):
        return
    if start < end and _plain(text[start:end]) and not any(_THING.fullmatch(w) for w in words) and not _after_article(text, start):
        found.append((start, end, "name"))


_HAN_NAME = re.compile(_HAN)
_HAN_STOP = set("的了在是和与或把被对从到将就都也还再只已未请这那其此该各每第之前后上下里外中间时候会可能要应为因所以如果但而且不没有")


def _han_after(text: str, pos: int, found: list) -> None:
    m = re.compile(r"[一-鿿]{2,4}(?=[，,。！!；：:\s（(]|$)").match(text, pos)
    if m and not set(m.group()) & _HAN_STOP:
        found.append((m.start(), m.end(), "name"))


def _han_before(text: str, end: int, found: list) -> None:
    m = re.compile(r"(?:^|(?<=[^一-鿿]))[一-鿿]{2,4}$").search(text, max(0, end - 5), end)
    if m and not set(m.group()) & _HAN_STOP:
        found.append((m.start(), m.end(), "name"))


# --- names by their own form ---------------------------------------------------------------------------

#: Given names (a parameter of the lexicon, as are the phrases): a capitalised pair that begins with one is a name.
GIVEN = frozenset(
    """
    aaron abigail adam adrian agnes ahmed aisha alan albert alejandro alex alexander alexandra alice alicia alina amanda amelia amy ana andre andrea
    andreas andrew angela anita ann anna anne annika anthony antoine antonio arjun arthur astrid barbara beatrice beatriz ben benjamin bernard bernd
    bettina birgit bob boris brian bruno camille carla carlos carmen carol caroline catherine cecilia charles charlotte chloe chris christian christina
    christine christoph christopher claire clara claudia claudio clement craig cristina cynthia daniel daniela david deborah denise dennis diana diego dieter
    dirk dmitri dominik donald dorothea edward eduardo elena eleanor elias elisa elisabeth elizabeth ella elsa emil emilia emily emma enrique eric erik
    esteban ethan eva fabian fatima felipe felix fernando fiona florence florian francesca francis francisco frank franz frederic frieda friedrich gabriel
    callum edith marisol thibault apolline solene friederike swantje inigo mara esther ezra farah gareth gemma gilles giulia guadalupe haruto hiroshi igor ilse imran
    ingo jill jordi joyce juliette kenji kerstin khalid lachlan ling lucien luka malik marguerite mehdi milan mina mohammad nils noemi omer oswin paolo pilar quentin rafaela
    ramon rosario rosie saskia sean shreya sigrid silke soren tariq tatiana thea tilda torsten veit vikram wiebke xin yara yuki zainab zeynep
    gabriela george gerald gerhard gisela gloria gonzalo grace greg gregory guillaume gustav hanna hannah hans harold harry hassan hazel heather heidi
    heike heinrich helen helena helene helga henri henrik henry hugo ian ibrahim ignacio imogen ines ingrid irene isabel isabelle isla ivan jack jacob
    jacqueline jacques jakob james jan jana jane janet jasmin jasper javier jean jeff jennifer jens jeremy jessica joachim joan joanna joaquin joel johann
    johanna john jonas jonathan jorge jose josef joseph joshua juan judith julia julian julie julien jurgen karen karin karl katharina katherine kathleen
    katrin keith kevin kim klaus kofi kristin kurt lars laura laurent lea leila lena leo leon leonardo linda lisa lorenz louis louise luc lucas lucia lucy
    ludwig luis luisa lukas lydia manfred manuel manuela marc marcel marco marcos margaret maria mariana marie marina mario marion mark markus marta
    martha martin martina mary mateo matilda matthew matthias maximilian mehmet melanie melissa mia michael michel michelle miguel mohamed mohammed monica
    monika nadia nadine nancy natalia natalie nathan nicholas nicolas nicole niklas nina noah nora olga oliver olivia omar oscar oskar otto pablo pamela
    pascal patricia patrick paul paula pauline pedro peter petra philip philipp philippe pierre priya rachel rafael rainer raj ralf raphael raul rebecca
    renate richard robert roberto robin roger roland ronald rosa ruben rufus ruth ryan sabine sally samuel sandra santiago sara sarah sebastian sergio
    sharon silvia simon simone sofia sonja sophia sophie stefan stefanie stella stephan stephanie stephen steve steven sven susan susanne sylvia tamara
    tanja teresa theo theodor theresa thomas tim timothy tina tobias tom tomas torben ulrich ulrike ursula uwe valentina valerie vanessa vera veronica
    victor victoria vincent virginia walter warren wendy werner wilhelm william wolfgang xavier yasmin yusuf yves zoe
    """.split()
)
_U = r"[A-ZÀ-ÖØ-ÞŁŚŞŠČŽ][A-Za-zÀ-ÖØ-öø-ɏ]+(?:['’-][A-ZÀ-ÖØ-ÞŁŚŞŠČŽ][A-Za-zÀ-ÖØ-öø-ɏ]*)*"
_U1 = r"[A-ZÀ-ÖØ-ÞŁŚŞŠČŽ]\."
_LINK = r"(?:(?:de|del|de la|von|van|van der|van den|di|da|bin|le|la) )?"
_FORM = re.compile(
    rf"(?<![\w@.+/'’:-])(?:(?P<ini>(?:{_U1} ?){{1,2}}){_LINK}{_U}|(?P<given>{_U})(?: {_U1}){{0,2}} {_LINK}(?P<family>{_U}))(?: (?={_U}){_U})?(?![\w@/]|-\w|\.\w)"
)
#: What is named after people, or stands in capitals without being a person.
_THING = re.compile(
    r"(?:algorithm|anchor|api|app|backend|bot|branch|broker|bucket|bus|cache|center|centre|class|client|cluster|collector|component|computer|conjecture|config|court|daemon|"
    r"database|desk|diagram|drive|effect|engine|filter|font|foundation|framework|function|gate|gateway|group|hall|handler|helper|hospital|house|hub|index|indexer|institute|job|lane|law|"
    r"library|linker|loader|method|mirror|module|node|number|office|packer|parser|pattern|pipeline|place|platform|pool|prize|process|project|proxy|queue|reader|relay|release|renderer|"
    r"repository|road|runner|sampler|scheduler|school|script|server|service|square|storage|store|street|suite|support|sync|system|team|test|theorem|timer|tool|university|version|"
    r"volume|watcher|weaver|worker|writer|address|contact|mail|email|phone|telephone|hotline|helpline|dienst|server|gruppe|modul|servicio|módulo|équipe|module|projet)s?\b",
    re.IGNORECASE,
)
_ARTICLE = re.compile(r"\b(?:the|a|this|that|each|every|der|die|das|den|dem|ein|eine|einen|el|los|las|un|una|les|une)[ \n]$", re.IGNORECASE)
#: Words that begin sentences or stand in capitals beside addresses and numbers, and are no part of a name.
_WORD = frozenset(
    """
    yesterday today tomorrow later according gestern heute laut gemäß ayer hoy según hier selon
    the a an our each every whatever this that these those it its he she they we you i and or but if in on at to from for of by with as is are was when while
    where who why how what which then there here after before since so no not note call ping ask tell mail email write contact phone tel mobile fax text see use
    dear hi hello thanks thank please reply send sent reviewed signed cc bcc order invoice ticket build trace passport monday tuesday wednesday thursday friday saturday sunday
    january february march april may june july august september october november december street road lane avenue
    der die das den dem ein eine wir sie er ich und oder aber bei bitte danke frau herr herrn kontakt telefon rückfragen siehe nach von für mit
    el la los las un una y o pero si en de del con por para gracias pregunta llame llama teléfono correo contacto
    le les une et ou mais si dans avec pour merci demande appelez téléphone courriel
    """.split()
)
_BESIDE = re.compile(r",? ?[<(\[:–-]? ?(?:(?:at|on|via|unter|en|au|tel\.?|mobile|email|mail|phone)[.:]? )?", re.IGNORECASE)


#: After these, "M." is a title.
_MONSIEUR = re.compile(r"\b(?:à|de|par|chez|que|et|avec|pour|merci|bonjour|cher) $", re.IGNORECASE)
#: Frequent Chinese surnames; with a title behind, one begins a name.
_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_HAN_DOER = re.compile(rf"(?:^|(?<=[^一-鿿]))[{_SURNAMES}][一-鿿]{{1,2}}$")
_HAN_TITLED = re.compile(rf"[{_SURNAMES}][一-鿿]{{0,2}}$")
HAN_TITLES = ("先生", "女士", "小姐", "博士", "教授")


def _after_article(text: str, start: int) -> bool:
    """Whether an article stands before `start`; "an" is one only before a vowel, else a German preposition."""
    return bool(_ARTICLE.search(text, max(0, start - 8), start)) or (
        text[max(0, start - 4) : start].lower() == " an " and text[start : start + 1].lower() in "aeiou"
    )


def _no_name(word: str) -> bool:
    return word.lower() in _WORD or bool(_THING.fullmatch(word))


def _formed(text: str, places: list[tuple[int, int]], found: list) -> None:
    """Names by given name, initial, or an email address or phone number of `places` beside them."""
    for m in _FORM.finditer(text):
        start, end = m.span()
        words = m.group().split(" ")
        while len(words) > 1 and words[0].lower() in _WORD:  # a sentence's first word
            start += len(words[0]) + 1
            words = words[1:]
        while len(words) > 2 and words[-1].lower() in _WORD:  # the next sentence's or a weekday
            end -= len(words[-1]) + 1
            words = words[:-1]
        if len(words) > 2 and _bare(words[0]) not in GIVEN and (_bare(words[1]) in GIVEN and words[2][1:2] != "."):
            start += len(words[0]) + 1  # a capital before the given name
            words = words[1:]
        if len(words) < 2 or words[-1][1:2] == "." or any(_no_name(w) for w in words):
            continue
        if (end < len(text) and text[end] == " " and _THING.match(text, end + 1)) or _after_article(text, start):
            continue  # what is named after someone
        first = _bare(words[0])
        if words[0][1:2] == "." or words[1][1:2] == ".":
            if words[0] == "M." and _MONSIEUR.search(text, max(0, start - 10), start):
                start += 3
            found.append((start, end, "name"))
        elif first in GIVEN or first.partition("-")[0] in GIVEN:
            found.append((start, end, "name"))
        elif any(_BESIDE.fullmatch(text, end, s) for s, _ in places if 0 < s - end <= 12) or any(
            re.fullmatch(r" ?[(,<] ?", text[e:start]) for _, e in places if 0 < start - e <= 3
        ):
            found.append((start, end, "name"))


def _bare(word: str) -> str:
    """In small letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _misspelt(cue: str) -> set[str]:
    """The cue with one letter left out, doubled into another, replaced or put in, or two neighbours exchanged."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    out: set[str] = set()
    for i in range(len(cue.rstrip())):
        if cue[i].isalpha():
            out.add(cue[:i] + cue[i + 1 :])
            out |= {cue[:i] + c + cue[i + 1 :] for c in letters}
            if cue[i + 1].isalpha():
                out.add(cue[:i] + cue[i + 1] + cue[i] + cue[i + 2 :])
        out |= {cue[:i] + c + cue[i:] for c in letters}
    return out - {cue}


# --- the automaton -------------------------------------------------------------------------------------

#: Labels of numbers issued to a person; the number follows within a few words.
ID_LABELS = (
    "passport", "social number", "social security", "ssn", "national id", "national insurance", "insurance number", "tax id",
    "tax number", "taxpayer", "identity number", "id number", "steuernummer", "steuer-id", "steuer-idnr", "ausweis", "reisepass",
    "sozialversicherungsnummer", "dni", "nie ", "nif ", "seguridad social", "pasaporte", "numéro de sécu", "sécurité sociale", "nir ", "passeport", "numéro fiscal", "身份证", "护照",
    "社保号", "税号", "tax code", "personal number", "nino", "personalausweis", "número de identidad", "número fiscal", "carte d'identité",
)
_STREETS = {
    _EN: ("street", " st.", " st,", " st ", " st#", "road", " rd", " lane", " ln", " drive", " dr", " ave", " blvd", "boulevard", " ct", " court", " terrace", " close", " way", " place", " square", " row", " crescent"),
    _DE: ("straße ", "strasse ", "str. ", "gasse ", "weg ", "platz ", "ufer ", "ring ", "allee ", "damm ", "steig ", "markt ", "graben "),
    _ES: ("calle ", "c/", "avda", "avenida ", "paseo ", "plaza ", "camino ", "ronda ", "travesía ", "carrera ", "cuesta ", "glorieta "),
    _FR: (" rue ", " bd ", " boulevard ", " avenue ", " quai ", " chemin ", " impasse ", " place ", " allée ", " cours ", " route "),
    _ZH: ("号",),
}


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    table: dict[str, list] = {}

    def add(cue: str, *what) -> None:
        table.setdefault(cue, []).append((len(cue), *what))

    for cue in ("@", "(at)", "[at]", "( at )", "[ at ]", " dot "):
        add(cue, "email")
    for cue in ID_LABELS:
        add(cue, "id")
    for form, cues in _STREETS.items():
        for cue in cues:
            add(cue, "address", form)
    known = {*SURE, *LIKELY, *TITLES}
    for cues, sure in ((SURE, True), (LIKELY, False)):
        for cue in cues:
            add(cue, "before", sure, False)
            if sum(c.isalpha() for c in cue) >= 5 and cue[-1] == " ":  # with one typing error; such a phrase is no sure one
                for wrong in _misspelt(cue) - known:
                    if wrong.strip() not in _SMALL and wrong.strip() not in _WORD:
                        add(wrong, "before", None, False)
    for cue in TITLES:
        add(cue, "before", False, True)
    for cue in AFTER:
        add(cue, "after", cue)
    for cue in HAN_BEFORE:
        add(cue, "han_before")
    for cue in HAN_AFTER:
        add(cue, "han_after")
    for cue in HAN_DOING:
        add(cue, "han_doing")
    for cue in HAN_TITLES:
        add(cue, "han_title")
    a = ahocorasick.Automaton()
    for cue, whats in table.items():
        a.add_word(cue, whats)
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every mention in one text, in order, without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    for last, whats in _automaton().iter(_lower(text)):
        for n, what, *args in whats:
            first, end = last - n + 1, last + 1
            if what == "email":
                _emails(text, first, found)
            elif what == "address":
                _addresses(text, first + 1 if n > 1 else first, args[0], found)
            elif what == "before":
                if args[1] and not (text[first].isupper() and text[first + 1].islower()):
                    continue  # a title, not a unit
                if first == 0 or not (text[first - 1].isalnum() or text[first - 1] in "_-"):
                    _name_after(text, end, args[0], args[1], found)
            elif what == "after":
                _name_before(text, first, args[0], found)
            elif what == "id":
                if first and text[first - 1].isalpha() and text[first - 1].isascii() and text[first].isascii():
                    continue
                g = _ID_GAP.match(text, end)
                m = _ID.match(text, g.end()) if g else None
                if m:
                    found.append((m.start(), m.end(), "id_number"))
            elif what == "han_before":
                _han_after(text, end, found)
            elif what == "han_doing":
                m = _HAN_DOER.search(text, max(0, first - 4), first)
                if m and not set(m.group()) & _HAN_STOP:
                    found.append((m.start(), first, "name"))
            elif what == "han_title":
                m = _HAN_TITLED.search(text, max(0, first - 3), first)
                if m:
                    found.append((m.start(), first, "name"))
            else:
                _han_before(text, first, found)
    for d in _DIGITS.finditer(text):
        lo = max(0, d.start() - 3)
        for m in _PHONE.finditer(text, lo, min(len(text), d.end() + 24)):  # an extension has at most 20 characters
            n = sum(c.isdigit() for c in re.split(r"[a-z分]", m.group(), maxsplit=1, flags=re.IGNORECASE)[0])
            if 9 <= n <= 16:
                found.append((m.start(), m.end(), "phone"))
    _formed(text, [(s, e) for s, e, k in found if k in ("email", "phone")], found)
    # A number issued to a person also stands soon after the name, unless it is called something else.
    for s, e, k in [f for f in found if f[2] == "name"]:
        g = _ID_NEAR.match(text, e)
        m = _ID.match(text, g.end()) if g and not _OTHER_NUMBER.search(g.group()) else None
        if m and sum(c.isdigit() for c in m.group()) >= 6:
            found.append((m.start(), m.end(), "id_number"))
    if len(found) < 2:
        return found
    found.sort(key=lambda x: (KINDS.index(x[2]), x[0] - x[1], x[0]))
    taken: list[tuple[int, int, str]] = []
    for s, e, k in found:
        if k == "name":  # a name after an address may be read as its last part
            s = max([s, *(b for a, b, _ in taken if a < s + 1 <= b < e and text[b : b + 1].isspace())])
            while s < e and text[s].isspace():
                s += 1
        if s < e and all(e <= a or s >= b for a, b, _ in taken):
            taken.append((s, e, k))
    return sorted(taken)


def find(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per mention: `keep`, kind, char_start, char_end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[list] = [[] for _ in range(len(keep) + 3)]
            others = [pdf.iloc[:, c].tolist() for c in range(len(keep))]
            for i, t in enumerate(pdf["_text"]):
                if isinstance(t, str):
                    for s, e, k in mentions(t):
                        for col, value in zip(out, [*(o[i] for o in others), k, s, e]):
                            col.append(value)
            names = [*keep, "kind", "char_start", "char_end"]
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(names, out)})

    kept = rows.select(*keep, F.col(text).cast("string").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInPandas(run, f"{types}, kind string, char_start bigint, char_end bigint")


def redacted(text: str) -> str:
    """One text with every mention replaced by its kind's placeholder; all else stays as it was."""
    out, at = [], 0
    for s, e, k in mentions(text):
        out += [text[at:s], PLACEHOLDERS[k]]
        at = e
    return "".join(out) + text[at:]


def redact(text: Column) -> Column:
    """The column with mentions replaced; null stays null."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t) if isinstance(t, str) else None)

    return run(text)


def redacted_rows(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep` and `redacted` of the rows that hold a mention, in one pass over the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = [redacted(t) if isinstance(t, str) else None for t in pdf["_text"]]
            changed = [i for i, (n, t) in enumerate(zip(new, pdf["_text"])) if n is not None and n != t]
            out = {k: pd.Series([pdf[k].iat[i] for i in changed], dtype=object) for k in keep}
            yield pd.DataFrame({**out, "redacted": pd.Series([new[i] for i in changed], dtype=object)})

    kept = rows.select(*keep, F.col(text).cast("string").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInPandas(run, f"{types}, redacted string")
