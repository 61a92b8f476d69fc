"""Personal information in free text: weak supervision over candidate spans (problem 3).

1. One pass over whole texts finds candidate spans of five types with generous patterns: e-mail
   addresses in any notation, groups of digits and of digit words, street addresses, first
   names followed by another name, and capitalised pairs with any other first word where a title
   or a word said of persons stands next to them. Each candidate carries the votes of its type's labelers
   (regular expressions, gazetteers, context words before and after, counter-evidence such as
   file names, order numbers or typefaces; each says yes, no, or abstains) and its features.
2. Expectation-maximisation over the counts of all vote patterns estimates the reliability of
   every labeler and a probability for each pattern.
3. A logistic span classifier for each type is trained on these probabilities, over at most
   ``sample`` candidates (chosen by hash), from votes, shape and context features.
4. The classifier decides on every candidate; overlapping spans of a text are resolved by type
   (e-mail, id number, address, phone, person) and probability. Accepted spans are numbered by
   type and field, and replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]``,
   ``[PERSON]``; all other text stays as it is.

Defined cases: null and empty texts have no spans; texts are never cut; repeated rows are each
reported; an empty table gives empty results; other columns are ignored. Offsets count code
points.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, staged
from .weak import estimate

TYPES = ("email", "id_number", "address", "phone", "person")
FEATURES = 1024
SAMPLE = 60_000

# Gazetteers and context words, in the languages of the texts.
FIRST_NAMES = """
Adam Ahmed Aisha Aleksandr Alice Alicia Amara Amelie Amina Amir Ana Anders Andrea Andrei Anja Anna Anouk Antoine Antonio
Arjun Astrid Ayesha Bastien Beatriz Begoña Bianca Bjorn Boris Bruno Camille Carla Carlos Carmen Catherine Cecilia
Chiara Chloe Claudia Dario David Deepa Diego Dmitri Dominik Elena Elif Elise Élodie Emil Emilia Emma Enrique
Erik Esra Esther Eva Fatima Felix Fernando Florian Francesca Frederik Freya Gabriel Gideon Giulia Greta Guillaume Gustav
Hanae Hannah Hans Hassan Heidi Helena Henrik Hiroshi Hugo Ibrahim Idris Ilse Ines Ingrid Irina Isabel Ivan Jakob James
Jan Javier Johanna John Jorge José Juan Julia Jürgen Karim Karin Katarina Kenji Klaus Kofi Lars Laura Leila Leonardo
Linnea Lotte Luca Lucia Ludwig Luis Magdalena Malik Manuel Maria Mariana Marie Marta Martin Mateo Matilda Matteo
Mei Michael Miguel Mikael Mireia Mohammed Nadia Naomi Natalia Niklas Nikolai Nina Noemi Nora Oksana Olga Oliver Omar
Oscar Pablo Paola Patricia Paul Pavel Pedro Peter Petra Pierre Priya Rafael Rahul Raquel Ravi Robert Ruben Ruth Salma
Samira Samuel Sara Sebastian Silas Simone Sofia Solveig Søren Stefan Sven Takeshi Tariq Tatiana Teodor Teresa Theo Thomas
Tobias Tomas Valentina Vera Viktor Wei William Yara Yasmin Youssef Yuki Yusuf Zainab Zofia
Aaron Abigail Adrian Agnes Alan Albert Alejandro Alessandro Alex Alexander Alexandra Alfred Alfredo Alina Allison Amanda Amy
Andrew Angela Anita Ann Anne Anthony Arthur Axel Barbara Beatrice Benjamin Bernd Bernhard Birgit Brandon Brian Brigitte
Britta Bruce Camila Carolina Caroline Céline Charles Charlotte Christian Christina Christine Christopher Clara Clémence Cristina
Cynthia Daniel Daniela Deborah Denise Dennis Diana Dieter Dirk Dorothy Eduardo Edward Eleanor Eleni Elizabeth Emily
Eric Ernesto Esteban Eugene Fabian Fatou Federico Felicia Finn Fiona Francisco François Franz Friedrich Gary Geoffrey
George Gerhard Gertrud Giorgio Giovanni Gonzalo Graham Gregory Guillermo Günter Hanna Harold Harry Hélène Helen Helga Henry
Horst Ignacio Ingo Isabelle Jacob Jacques Jake Jana Janet Jasmin Jason Jean Jeffrey Jennifer Jens Jeremy Jessica
Joachim Joanna Joan Joel Jonas Jonathan Joseph Joshua Josef Juliette Julian Julien Julie Justin Karen Karl Katharina Katherine Kathrin
Katie Keith Kelly Kenneth Kevin Kim Kimberly Larry Laurent Lena Leon Léa Linda Lisa Lorenzo Louis Louise Lukas Luke
Lydia Maja Manfred Marcel Marco Marcus Margaret Margot Markus Mathieu Matthew Matthias Megan Melanie Melissa Michelle Miriam
Mohamed Monica Monika Moritz Muhammad Nancy Natalie Nathan Nicholas Nicolas Nicole Noah Olivia Owen Pamela Pascal Patrick Paula
Philip Philipp Philippe Rachel Raphael Raymond Rebecca Renate Ricardo Richard Roberto Roger Ronald Rosa Roxane Ryan Sabine
Samantha Sandra Sarah Scott Sergio Sharon Silvia Simon Sophia Sophie Stefanie Stephanie Stephen Steven Susan Susanne Sylvia
Theresa Thierry Thorsten Timothy Tina Tom Tyler Ulrich Ursula Uwe Vanessa Véronique Victor Victoria Vincent Virginia Walter
Werner Wolfgang Xavier Yvonne Zachary Zoe
""".split()
DIGIT_WORDS = """
zero oh nought one two three four five six seven eight nine double triple
null eins zwei drei vier fünf sechs sieben acht neun zéro un deux trois quatre cinq sept huit neuf
cero uno dos tres cuatro cinco seis siete ocho nueve
""".split()
STREET_WORDS = """
road rd street st lane ln avenue ave drive court crescent terrace boulevard blvd square close parkway highway
way circle grove row trail mews gardens walk alley straße strasse str weg gasse platz allee rue chemin impasse quai place calle avenida paseo plaza carrera camino via viale
""".split()
FILE_ENDINGS = "png jpg jpeg gif svg webp pdf psd mp4 mov zip css html js ttf otf woff".split()
TYPEFACE_WORDS = "serif sans grotesk grotesque mono display slab script condensed regular bold italic font typeface variable".split()
PHONE_BEFORE = "call text phone tel telephone whatsapp mobile cell fax handy ring dial number contact reach signal sms hotline landline ruf rufen anrufen telefon nummer appelez téléphone numéro llama llame teléfono móvil número telefono ☎ 📞 📱".split()
PHONE_AFTER = "anytime if or an always after before between ask extension ext".split()
ID_BEFORE = "ssn social security passport reisepass passeport pasaporte steuer-id steuer steuernummer ausweis ni nino national insurance tax tin id identity identification dni nif nie insee nir licence license personalausweis iban account konto compte cuenta aadhaar pan citizen citizenship resident permit visa medicare nhs card document documento dokument".split()
ID_AFTER = "clearly visible expires issued expired".split()
ADDRESS_BEFORE = "address adresse dirección addr ship send deliver mail post to at visit come by live lives living office studio shop warehouse headquarters moved relocated located based located wohnt wohne anschrift domicilio".split()
PERSON_BEFORE = "client by to for with from mit as dr prof mr mrs ms herr frau sr sra mme ask thank thanks together avec von con met meet called named and und et y fragt".split()
PERSON_AFTER = "told tells answers answered asks asked writes wrote says said im called calls sent sends emailed thinks thought who whose".split()
#: Of these a title, or a word said of persons only, is enough beside a capitalised pair of any words.
PERSON_SURE = "client thanks thank ask asked met meet meeting contact contacted email emailed call called phoned fragt said says told tell interviewed hired joined visited introduced recommended named together freelancer designer colleague coworker boss friend mentor editor teacher tutor professor director manager assistant engineer developer artist photographer illustrator founder author owner neighbour neighbor sister brother mother father wife husband son daughter cousin uncle aunt doctor nurse lawyer landlord tenant patient student kundin kunde kollege kollegin freundin chef cliente clienta amiga amigo collègue amie by".split()
PERSON_THEN = "told tells answers answered asks asked writes wrote says said explains explained replied replies called calls sent sends emailed thinks thought lives moved works worked joined founded spoke wants wanted loves loved agreed suggested recommended taught teaches showed shared introduced visited".split()
#: Street words that are common words too: the street's name is capitalised, or a code follows.
STREET_COMMON = "way place circle grove row trail mews gardens walk alley".split()
NUMBER_NO = "order post preset version price iso sku ref invoice item page ticket build v $ € £ # # bestellung pedido commande".split()
ARTICLES = "the a an el un una la los las del al cada sin dejan der die das den dem ein eine einen kein le les une ce chaque il lo".split()
NUMBER_NO_AFTER = "got saves beats iso arrived px pixels pt usd eur percent %".split()

_GAP = r"(?:[ \t ]|[ \t]?\r?\n(?:>[ ]?)?)"
_AT = re.compile(r"\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?|@|＠", re.I)
_SPELLED = re.compile(r"[\w.+-]+ (?:at|arroba) ([\w-]+(?: (?:dot|punto|punkt|point) [\w-]+)+)", re.I)
_LOCAL = re.compile(r"[\w.+%'-]")
_DOMAIN = re.compile(r"[\w-]+(?:(?:\.|\s?[\[({]\s?(?:dot|punto|punkt|point|\.)\s?[\])}]\s?| dot )[\w-]+)+", re.I)
_RUN = re.compile(r"(?:\+|\()?\d(?:[\d()./  -]*|\r?\n> ?(?=\d))*\d")
_NINO = re.compile(r"\b[A-Za-z]{2}" + _GAP + r"?\d\d" + _GAP + r"?\d\d" + _GAP + r"?\d\d" + _GAP + r"?[A-Da-d]\b")
_NINO_TAIL = re.compile(r"(?<![\d.,])\d\d" + _GAP + r"?\d\d" + _GAP + r"?\d\d" + _GAP + r"?[A-Da-d](?![\w-])")
_TWO_LETTERS = re.compile(r"(?<![\w-])[A-Za-z]{2}" + _GAP + r"?$")
_CODE = re.compile(r"\b[A-Za-z]{1,3}\d{6,9}\b|\b\d{7,8}[A-Za-z]\b|\b(?=[A-Z]*\d[A-Z]*\d)[A-Z][A-Z0-9]{7,11}\b")
_IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])")
_NANP = re.compile(r"(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}$")
_INTERNATIONAL = re.compile(r"(?:\+|00)\d[\d ()./-]{6,18}\d$")
_TRUNK = re.compile(r"(?=(?:\D*\d){9})(?:\(?0\d{1,5}\)?(?:[ ./-]\d{2,8}){1,4}|0\d{9,10})$")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}$")
_TAX = re.compile(r"\d{2} \d{3} \d{3} \d{3}$")
#: A number in a longer run, between blanks or slashes; where two numbers of a run are set apart.
_INSIDE = re.compile(r"(?<![^ /])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\d{3}-\d{2}-\d{4})(?![^ /])")
_APART = re.compile(r"\s*/\s+|\s+/\s*|\s{2,}|\s+-+\s+|(?<=\d)\s+(?=\(\d)|(?<=\d{4}) (?=\d{1,2}/\d)")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}$|\d{1,2}[./]\d{1,2}[./]\d{2,4}$")
_UP = r"[^\W\d_][\w'’-]*"
_PLACE = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*(?!\w)"
#: Street words that are written as the end of a longer word.
_SUFFIXES = frozenset("straße strasse str weg gasse platz allee".split())
_EN = re.compile(rf"(?<![\w.,-])(\d{{1,5}}[a-z]?){_GAP}((?:{_UP}{_GAP}){{1,3}}?)(road|rd|street|st|lane|ln|avenue|ave|drive|court|crescent|terrace|boulevard|blvd|square|close|parkway|highway|way|place|circle|grove|row|trail|mews|gardens|walk|alley)\b\.?", re.I)
_EN_TAIL = re.compile(rf"(?:,?{_GAP}(?:apt|apartment|suite|unit|flat)\.?{_GAP}\w+)?(?P<town>,{_GAP}?{_PLACE}(?:{_GAP}(?-i:(?![A-Z]{{2}}{_GAP}\d)[A-ZÀ-Þ])[^\W\d_]+(?!\w))?)?(?P<code>,?{_GAP}(?:[A-Z]{{2}}{_GAP}\d{{5}}|[A-Z]{{1,2}}\d[\dA-Z]?{_GAP}\d[A-Z]{{2}}))?", re.I)
_LOW_TAIL = re.compile(rf"(?:{_GAP}(?:apt|apartment|suite|unit|flat)\.?{_GAP}\w+)?{_GAP}(?P<town>{_PLACE})(?P<code>{_GAP}(?:[a-z]{{2}}{_GAP}\d{{5}}|[a-z]{{1,2}}\d[\da-z]?{_GAP}\d[a-z]{{2}}))", re.I)
_DE = re.compile(rf"({_UP}(?:straße|strasse|str\.|weg|gasse|platz|allee)|{_UP}{_GAP}(?:straße|strasse|weg|gasse|platz|allee)){_GAP}(\d{{1,4}}[a-z]?)\b(?P<town>,?{_GAP}\d{{4,5}}{_GAP}{_UP})?", re.I)
_FR = re.compile(rf"(\d{{1,4}}),?{_GAP}(?:bis{_GAP})?(?:rue|avenue|boulevard|chemin|impasse|quai|place|allée){_GAP}(?:(?:de{_GAP}la|de|du|des|d'|l'){_GAP}?)?{_UP}(?P<town>,?{_GAP}\d{{5}}{_GAP}{_UP})?", re.I)
_ES = re.compile(rf"(?:calle|avenida|paseo|plaza|carrera|camino|via|viale){_GAP}(?:(?:de{_GAP}la|de|del){_GAP})?{_UP}(?:{_GAP}{_UP})?{_GAP}?,?{_GAP}?(\d{{1,4}})\b(?P<town>,?{_GAP}\d{{4,5}}{_GAP}{_UP})?", re.I)
_NAME_TAIL = re.compile(rf"(?:{_GAP}(?P<initial>[^\W\d_]\.?))?{_GAP}(?P<family>(?:(?:van|von|de|del|della|di|da|le|la|bin|al|el|O['’]|Mc){_GAP}?){{0,2}}[^\W\d_][\w'’]+(?:-[^\W\d_][\w'’]+)?)")
_TITLE = re.compile(rf"(?:^|[^\w])(?:dr|prof|mr|mrs|ms|mx|herr|frau|sr|sra|srta|mme|mlle|don|doña)\.?{_GAP}$")
_PAIR = re.compile(rf"(?<![\w@./+#'’-])(?-i:[A-ZÀ-Þ])[^\W\d_]+(?:['’-][^\W\d_]+)*(?={_GAP}[^\W\d_])")
_WORD = re.compile(r"[\w'’-]+|[^\w\s]")


def _plain(word: str) -> str:
    return word.lower()


_FIRST = {_plain(n) for n in FIRST_NAMES} | {_plain(n).replace("ü", "u").replace("ö", "o").replace("ø", "o").replace("é", "e").replace("ñ", "n") for n in FIRST_NAMES}
_DIGIT = set(DIGIT_WORDS)


def automaton() -> ahocorasick.Automaton:
    """Finds first names (p), digit words (d), street words (a) and id words (i) in lower case."""
    a = ahocorasick.Automaton()
    kinds: dict[str, str] = {}
    for words, kind in ((_FIRST, "p"), (_DIGIT, "d"), (STREET_WORDS, "a"), (("passport", "passport no", "reisepass", "pasaporte", "passeport", "ni number", "dni", "nif", "ausweis", "identity", "identity number", "identity no", "id", "id number", "tax id", "insurance", "licence", "license", "permit"), "i")):
        for w in words:
            kinds[w] = kinds.get(w, "") + kind
    for w, k in kinds.items():
        a.add_word(w, (len(w), k))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


#: A full stop after these ends no sentence.
_SHORT = ("dr. ", " st. ", " no. ", " nr. ", "prof. ", " tel. ", " num. ")


def _context(low: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The three words before and the two after a span, of the same sentence or line."""
    head = low[max(0, start - 48) : start]
    before = head if head.endswith(_SHORT) else re.split(r"[.!?\n](?:\s|$)", head)[-1]
    return _WORD.findall(before)[-4:], _WORD.findall(re.split(r"[.!?\n]", low[end : end + 32].lstrip(" "))[0])[:3]


def _words_left(text: str, at: int, n: int) -> int:
    """Where the ``n`` words before ``at`` begin."""
    for _ in range(n):
        while at and text[at - 1].isspace():
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
    return at


def _words_right(text: str, at: int, n: int) -> int:
    """Where the ``n`` words from ``at`` end."""
    size = len(text)
    for _ in range(n):
        while at < size and text[at].isspace():
            at += 1
        while at < size and not text[at].isspace():
            at += 1
    return at


def _any(words: list[str], listed) -> bool:
    return any(w in listed for w in words)


_SETS = {k: frozenset(v) for k, v in {"pb": PHONE_BEFORE, "pa": PHONE_AFTER, "ib": ID_BEFORE, "ia": ID_AFTER, "ab": ADDRESS_BEFORE, "nb": PERSON_BEFORE, "na": PERSON_AFTER, "no": NUMBER_NO, "noa": NUMBER_NO_AFTER, "face": TYPEFACE_WORDS, "article": ARTICLES, "sure": PERSON_SURE, "then": PERSON_THEN, "no_place": "grid set row column cell version page level chapter figure table layer map".split(), "street": [*STREET_WORDS, "calle"], "common": STREET_COMMON}.items()}
#: Before a number these say that somebody is reached there.
_PREPOSITIONS = (["on"], ["at"], ["under"], ["unter"], ["au"], ["al"])
_NO_NAME = frozenset([*PERSON_BEFORE, *PERSON_SURE, *ARTICLES, *STREET_WORDS, *TYPEFACE_WORDS, *ADDRESS_BEFORE, *PHONE_BEFORE, *NUMBER_NO, *DIGIT_WORDS, *"i we you he she they it my your our his her their and or but this that these those when if then now big many also new".split()])


def _features(kind: str, span: str, before: list[str], after: list[str], votes: list[int]) -> list[int]:
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", span))[:40]
    names = [f"s:{shape}", *(f"b{i}:{w}" for i, w in enumerate(reversed(before[-2:]))), *(f"a{i}:{w}" for i, w in enumerate(after[:2])), *(f"v{i}:{v}" for i, v in enumerate(votes) if v)]
    return sorted({zlib.crc32(f"{kind}|{n}".encode()) % FEATURES for n in names})


Candidate = tuple[str, int, int, list[int], list[int]]


def _add(out: list[Candidate], kind: str, text: str, low: str, start: int, end: int, votes: list[int], context=None) -> None:
    before, after = context or _context(low, start, end)
    out.append((kind, start, end, votes, _features(kind, text[start:end], before, after, votes)))


def _emails(text: str, low: str, out: list[Candidate]) -> None:
    for m in _AT.finditer(text):
        domain = _DOMAIN.match(text, m.end())
        start = m.start()
        while start and _LOCAL.match(text[start - 1]):
            start -= 1
        if start == m.start() or not domain:
            continue
        end = domain.end()
        last = re.findall(r"[\w-]+", low[domain.start() : end])[-1]
        first = low[domain.start()]
        votes = [
            1 if len(last) >= 2 and last.isalpha() else -1,
            -1 if last in FILE_ENDINGS else 1,
            -1 if first.isdigit() else 1,
            -1 if start and text[start - 1] in "/@" else 0,
        ]
        _add(out, "email", text, low, start, end, votes)
    if " dot " in low or " punto " in low or " punkt " in low or " point " in low:
        for m in _SPELLED.finditer(text):
            _add(out, "email", text, low, m.start(), m.end(), [1, 1, 0, 0])


def _whole(run: str) -> bool:
    return any(p.match(run) for p in (_NANP, _INTERNATIONAL, _TRUNK, _SSN, _TAX, _DATE))


def _parts(run: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The numbers ``run[a:b]`` is made of, where several were written side by side."""
    while a < b and not (run[a].isdigit() or run[a] in "+("):
        a += 1
    while a < b and not run[b - 1].isdigit():
        b -= 1
    piece = run[a:b]
    if len(piece) < 7:
        return
    if not _whole(piece):
        inner = _INSIDE.search(piece)
        if inner:
            yield a + inner.start(), a + inner.end()
            yield from _parts(run, a, a + inner.start())
            yield from _parts(run, a + inner.end(), b)
            return
        gap = _APART.search(piece)
        if gap and (sum(c.isdigit() for c in piece) > 15 or _whole(piece[: gap.start()]) or _whole(piece[gap.end() :])):
            yield from _parts(run, a, a + gap.start())
            yield from _parts(run, a + gap.end(), b)
            return
        if sum(c.isdigit() for c in piece) > 15:
            for m in re.finditer(r"(?<=\d)[ /]+(?=[\d(])", piece):
                if _whole(piece[: m.start()]):
                    yield a, a + m.start()
                    yield from _parts(run, a + m.end(), b)
                    return
    yield a, b


def _numbers(text: str, low: str, out: list[Candidate]) -> None:
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        marks = list(re.finditer(r"[\r\n>]+ ?|.", m.group(), re.S))
        run = "".join(" " if x.group()[0] in "\r\n>\xa0" else x.group() for x in marks)
        at = [m.start() + x.start() for x in marks] + [m.end()]
        for a, b in _parts(run, 0, len(run)):
            _number(text, low, at[a], at[b - 1] + 1, run[a:b], out)


def _number(text: str, low: str, start: int, end: int, run: str, out: list[Candidate]) -> None:
    if start and (text[start - 1].isalnum() or text[start - 1] in ".,_/#@$€£") or end < len(text) and (text[end].isalnum() or text[end] in "_@" or text[end] == "," and text[end + 1 : end + 2].isdigit()):
        return
    if "(" in run and ")" not in run:
        start, run = start + run.index("(") + 1 if run[0] == "(" else start, run.lstrip("(")
    digits = sum(c.isdigit() for c in run)
    if digits < 7:
        return
    context = _context(low, start, end)
    before, after = context
    no = _any(before[-3:], _SETS["no"]) or _any(after[:2], _SETS["noa"])
    phone = bool(_NANP.match(run) or _INTERNATIONAL.match(run) or _TRUNK.match(run))
    idlike = bool(_SSN.match(run) or _TAX.match(run))
    odd = bool(_DATE.match(run)) or digits > 15 and "-" not in run and " " not in run
    near_id, near_phone = _any(before, _SETS["ib"]), _any(before, _SETS["pb"]) or before[-1:] in _PREPOSITIONS and not _DATE.match(run)
    if not (phone or idlike or (near_id or near_phone) and before[-1] not in _SETS["no"]):
        return  # every labeler for it would abstain or say no
    no = no or odd and not near_id
    _add(out, "phone", text, low, start, end, [1 if phone and not _SSN.match(run) else -1 if digits > 15 else 0 if near_phone and not near_id else -1, 1 if near_phone else 0, 1 if _any(after, _SETS["pa"]) else 0, -1 if no else 0, -1 if idlike or near_id and not near_phone else 0], context)
    _add(out, "id_number", text, low, start, end, [1 if idlike else 0 if near_id and digits >= 8 and not phone else -1, 1 if near_id else 0, 1 if _any(after, _SETS["ia"]) else 0, -1 if no else 0, -1 if phone and not near_id else 0], context)


def _codes(text: str, low: str, start: int, seen: set, out: list[Candidate]) -> None:
    """Codes with letters after an id word that ends at ``start``."""
    window = text[start : _words_right(text, start, 8)]
    for m in (_NINO.search(window), _CODE.search(window)):
        if m and start + m.start() in seen:
            return
        if m:
            seen.add(start + m.start())
            a, b = start + m.start(), start + m.end()
            before, after = _context(low, a, b)
            _add(out, "id_number", text, low, a, b, [1, 1, 1 if _any(after, _SETS["ia"]) else 0, -1 if _any(before[-2:], _SETS["no"]) else 0, 0], (before, after))
            return


def _national(text: str, low: str, seen: set, out: list[Candidate]) -> None:
    """Two letters, six digits and a letter, wherever they stand."""
    for m in _NINO_TAIL.finditer(text):
        head = _TWO_LETTERS.search(text, max(0, m.start() - 5), m.start())
        if head and head.start() not in seen:
            seen.add(head.start())
            before, after = _context(low, head.start(), m.end())
            _add(out, "id_number", text, low, head.start(), m.end(), [1, 1 if _any(before, _SETS["ib"]) else 0, 1 if _any(after, _SETS["ia"]) else 0, -1 if _any(before[-2:], _SETS["no"]) else 0, 0], (before, after))


def _accounts(text: str, low: str, seen: set, out: list[Candidate]) -> None:
    """Account numbers of two letters, two check digits and up to thirty characters."""
    for m in _IBAN.finditer(text):
        compact = re.sub(r"\s", "", m.group())
        if not 15 <= len(compact) <= 34 or m.start() in seen:
            continue
        seen.add(m.start())
        right = int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
        before, after = _context(low, m.start(), m.end())
        _add(out, "id_number", text, low, m.start(), m.end(), [1 if right else -1, 1 if _any(before, _SETS["ib"]) else 0, 1 if _any(after, _SETS["ia"]) else 0, -1 if _any(before[-2:], _SETS["no"]) else 0, 0], (before, after))


def _digit_words(text: str, low: str, hits: list[tuple[int, int]], out: list[Candidate]) -> None:
    run: list[tuple[int, int]] = []
    for a, b in [*hits, (len(low) + 9, len(low) + 9)]:
        if run and (a - run[-1][1] > 4 or low[run[-1][1] : a].strip(" ,-\n\r>")):
            if len(run) >= 7:
                s, e = run[0][0], run[-1][1]
                before, after = _context(low, s, e)
                near = _any(before, _SETS["pb"]) or before[-1:] in _PREPOSITIONS
                _add(out, "phone", text, low, s, e, [1, 1 if near else 0, 1 if _any(after, _SETS["pa"]) else 0, 0, 0], (before, after))
            run = []
        run.append((a, b))


def _addresses(text: str, low: str, at: int, seen: set, out: list[Candidate]) -> None:
    """An address around the street word that begins at ``at``."""
    left, right = _words_left(text, at, 6), _words_right(text, at, 16)  # no pattern reaches over more words
    for pattern in (_EN, _DE, _FR, _ES):
        for m in pattern.finditer(text, left, right):
            if not m.start() <= at < m.end() or (pattern, m.start()) in seen:
                continue
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "@_"):
                continue
            seen.add((pattern, m.start()))
            end, town = m.end(), bool(m.groupdict().get("town"))
            if pattern is _EN:
                tail = _EN_TAIL.match(text, end)
                if tail.group("town") is None:
                    tail = _LOW_TAIL.match(text, end) or tail
                town = bool(tail.group("town"))
                if m.group(3).lower() in _SETS["common"] and not (town and tail.group("code")) and not all(w[0].isupper() for w in [*m.group(2).split(), m.group(3)]):
                    continue
                end = tail.end() if town or tail.group("code") else tail.end()
            context = _context(low, m.start(), end)
            before, after = context
            grid = _any(before[-2:], _SETS["no_place"]) or _any(after, ("grid",))
            _add(out, "address", text, low, m.start(), end, [1 if town else -1, 1 if _any(before, _SETS["ab"]) else 0, -1 if grid else 0, 1 if town and re.search(r"\d", text[m.end() - 8 : end]) else 0, 1 if pattern is not _EN else 0], context)


def _persons(text: str, low: str, start: int, end: int, out: list[Candidate], listed: bool = True) -> None:
    if start and (text[start - 1].isalnum() or text[start - 1] in "@._-+/#'") or end < len(text) and text[end] in "@._+/":
        return
    first = text[start:end]
    m = _NAME_TAIL.match(text, end)
    if not m:
        return
    family = m.group("family")
    before, after = _context(low, start, m.end())
    head = family.split()[-1]
    up = first[0].isupper()
    cased = 1 if up and head[0].isupper() else -1 if up else 0
    closed = -1 if head.lower() in _SETS["face"] or head.lower() in _NO_NAME or _any(before[-1:], ("set",)) else 0
    titled = bool(_TITLE.search(low, max(0, start - 8), start))
    if not listed:
        sure = titled or _any(before[-2:], _SETS["sure"]) or _any(after[:1], _SETS["then"])
        if not sure or first.isupper() and not titled or not head[0].isupper() or head.lower() in _NO_NAME or first.lower() in _NO_NAME or before[-1:] and before[-1].isdigit() or after[:1] and after[0].isdigit():
            return
        if head.lower() in _FIRST and not titled and _NAME_TAIL.match(text, m.end()):  # the next word begins the name
            return
    near, then = titled or _any(before[-2:], _SETS["nb"]) or not listed and _any(before[-2:], _SETS["sure"]), _any(after[:1], _SETS["na"]) or after[:1] == [","]
    common = -1 if _any(before[-1:], _SETS["article"]) or not up and not near and not then else 0
    votes = [cased, 1 if near else 0, 1 if then else 0, closed, 1 if m.group("initial") else 0, common]
    _add(out, "person", text, low, start, m.end(), votes, (before, after + [f"f:{head.lower()}"]))


def candidates(text: str, finder: ahocorasick.Automaton) -> list[Candidate]:
    """All candidate spans of one whole text."""
    out: list[Candidate] = []
    if not text:
        return out
    low = _lower(text)
    if "@" in text or "＠" in text or "at]" in low or "at)" in low or "at}" in low or "at " in low and (" dot " in low or " punto " in low or " punkt " in low or " point " in low):
        _emails(text, low, out)
    _numbers(text, low, out)
    digit_hits: list[tuple[int, int]] = []
    seen: set = set()
    n = len(low)
    _national(text, low, seen, out)
    _accounts(text, low, seen, out)
    for last, (size, kinds) in finder.iter(low):
        start, end = last + 1 - size, last + 1
        if end < n and (low[end].isalnum() or low[end] == "_"):
            continue
        bounded = not start or not (low[start - 1].isalnum() or low[start - 1] == "_")
        if not bounded:
            if size > 2 and low[start:end] in _SUFFIXES:
                _addresses(text, low, start, seen, out)
            continue
        if "a" in kinds:
            _addresses(text, low, start, seen, out)
        if "d" in kinds:
            digit_hits.append((start, end))
        if "p" in kinds:
            _persons(text, low, start, end, out)
        if "i" in kinds:
            _codes(text, low, end, seen, out)
    for m in _PAIR.finditer(text):
        if m.group().lower() not in _FIRST:
            _persons(text, low, m.start(), m.end(), out, listed=False)
    if len(digit_hits) >= 7:
        _digit_words(text, low, digit_hits, out)
    return out




def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = automaton()
    kind_of = {k: i for i, k in enumerate(TYPES)}
    shape = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))
    for batch in batches:
        keep, spans = [], []
        for r, text in enumerate(batch.column(2).to_pylist()):
            found = candidates(text, finder)
            if found:
                keep.append(r)
                spans.append([{"kind": kind_of[k], "start": a, "end": b, "votes": v, "features": f} for k, a, b, v, f in found])
        rows = pa.array(keep, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(spans, shape)], names=["id", "field", "spans"])


def fit(features: list[list[int]], target: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (last: bias) on probabilistic labels, by full-batch gradient steps with momentum."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.concatenate([np.asarray(f, np.int64) for f in features]) if len(features) else np.empty(0, np.int64)
    w, step = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    total = max(weight.sum(), 1e-9)
    for _ in range(rounds):
        z = np.bincount(rows, weights=w[cols], minlength=len(features)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        g = np.zeros_like(w)
        g[:FEATURES] = np.bincount(cols, weights=error[rows], minlength=FEATURES)
        g[-1] = error.sum()
        step = 0.9 * step - rate * (g / total + decay * w)
        w = w + step
    return w


def models(spans: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """The classifier of each type, from the candidates' votes (see the module's steps 2 and 3)."""
    flat = spans.select("id", "field", F.explode("spans").alias("s")).select("id", "field", "s.*")
    table = flat.groupBy("kind", "votes").count().collect()  # at most 3 ** 6 patterns for each type
    total = sum(r["count"] for r in table)
    probability: dict[tuple, float] = {}
    for kind in range(len(TYPES)):
        own = [r for r in table if r["kind"] == kind]
        if own:
            patterns, counts = np.array([r["votes"] for r in own]), np.array([r["count"] for r in own], float)
            posterior, _, _ = estimate(patterns, counts, prior=0.5)
            probability |= {(kind, tuple(r["votes"])): float(p) for r, p in zip(own, posterior)}
    step = max(1, -(-total // sample))
    chosen = flat.where(F.pmod(F.xxhash64("id", "field", "start"), F.lit(step)) == 0) if step > 1 else flat
    held = chosen.select("kind", "votes", "features").orderBy(F.xxhash64("kind", "votes", "features")).limit(2 * sample).toArrow().to_pylist()
    out = {}
    for kind in range(len(TYPES)):
        own = [r for r in held if r["kind"] == kind]
        if own:
            target = np.array([probability[kind, tuple(r["votes"])] for r in own])
            out[kind] = fit([r["features"] for r in own], target, np.abs(target - 0.5) * 2 + 0.05)
    return out


def _decide(weights: dict[int, np.ndarray], least: float):
    shape = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(2).to_pylist():
                rated = []
                for s in spans:
                    w = weights[s["kind"]]
                    p = 1 / (1 + float(np.exp(-np.clip(w[s["features"]].sum() + w[-1], -30, 30))))
                    if p >= least:
                        rated.append((s["kind"], -p, -(s["end"] - s["start"]), s["start"], s["end"]))
                taken: list[tuple] = []
                for k, p, _, a, b in sorted(rated):
                    if all(b <= x or a >= y for _, x, y, _ in taken):
                        taken.append((k, a, b, -p))
                out.append([{"kind": k, "start": a, "end": b, "p": p} for k, a, b, p in sorted(taken, key=lambda t: t[1])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, shape)], names=["id", "field", "found"])

    return run


def personal_spans(texts: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``id, field, found``: the accepted spans (kind, start, end, p) of each text that has any.

    ``texts``: ``id bigint``, ``field string``, ``text string``; (id, field) is unique.
    """
    ship(texts.sparkSession)
    shape = "id bigint, field string, spans array<struct<kind:int,start:int,end:int,votes:array<int>,features:array<int>>>"
    whole = texts.where("text is not null and text <> ''").select(F.col("id").cast("bigint"), "field", "text")
    spans = staged(whole.mapInArrow(_collect, shape), "pii-candidates")
    weights = models(spans, sample)
    found = spans.mapInArrow(_decide(weights, least), "id bigint, field string, found array<struct<kind:int,start:int,end:int,p:double>>")
    return found.where(F.size("found") > 0)


def occurrences(found: DataFrame) -> DataFrame:
    """``id, field, pii_type, pii_no, start, end`` for each accepted span."""
    names = F.array(*(F.lit(t) for t in TYPES))
    flat = found.select("id", "field", "found", F.posexplode("found").alias("at", "s"))
    earlier = F.size(F.filter(F.slice("found", 1, F.col("at") + 1), lambda x: x["kind"] == F.col("s.kind")))
    return flat.select("id", "field", F.element_at(names, F.col("s.kind") + 1).alias("pii_type"), earlier.cast("bigint").alias("pii_no"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def redacted(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` with ``redacted``: each accepted span replaced by the placeholder of its type."""
    names = F.array(*(F.lit(f"[{t.upper()}]") for t in TYPES))
    joined = texts.join(found, ["id", "field"], "left")
    parts = F.transform(
        "found",
        lambda s, i: F.concat(
            F.substring(F.col("text"), F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("found"), F.greatest(i, F.lit(1)))["end"]) + 1, s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("found"), F.greatest(i, F.lit(1)))["end"])),
            F.element_at(names, s["kind"] + 1),
        ),
    )
    rest = F.substring(F.col("text"), F.element_at(F.col("found"), -1)["end"] + 1, F.length("text"))
    return joined.withColumn("redacted", F.when(F.col("found").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), rest))).drop("found")
