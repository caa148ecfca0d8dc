"""Personal information in free text: candidate spans, boosted trees that judge them, and typed placeholders."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkstream.functions.text import ODD_SPACES
from chalkstream.llm.boost import Boosted

KINDS = ("email", "phone", "id_number", "address", "name")
#: Public vocabulary whose whole-word entries serve as a list of ordinary words; the path must exist on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Given names, by the common spelling; accents and case are ignored.
GIVEN = (
    "aaron abigail adam ahmed aisha alice amara amelia amir amy ana andrew anna anton asa ava ben bilal bjork bronte callum carlos charlotte chloe daniel david diego dylan ella elif elsie emil emily emma esme ethan eva farah "
    "fatima felix finn freya george gethin grace hannah harry hassan hazel henry hugo ibrahim idris imani isaac isla ivy jack jacob jamal james jasmine jin jonas jose joseph joshua kai kezia kwame layla leila lena leo "
    "liam lily linnea luca lucas lucy marnie mateo matthew maya mei mia michael mohammed nadia niamh noah noor olivia omar orla oscar otis pearl peter poppy priya rachel renee rhys rohan rosa ruben ruby ryan samir samuel sara sarah sian "
    "sofia sophie stefan talia tariq thomas tobias viktor william wren yuki yusuf zara zoe"
).split()
# Titles, street types, spoken digits and numbers.
TITLES = "mr mrs ms miss mx dr prof professor sir madam".split()
STREETS = "street st road rd avenue ave lane ln drive dr close cl way court ct place pl mews parade hill gardens gdns crescent cres terrace terr boulevard blvd walk row rise grove square sq view green quay yard wharf".split()
DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0", "o": "0", "nought": "0"}
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SMALL = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()

SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"
#: A hesitation that may stand inside a candidate.
_UM = r"(?:(?:u-?u*h?m+|u+h+m*|e+r+m*|h+m+|m{2,}),?(?:\.\.\.)?\s+)?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:\s?@\s?|\s?\[at\]\s?|\s?\(at\)\s?)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)"
_EMAIL = re.compile(rf"[A-Za-z0-9À-ÿ][\w.+'’-]*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}|[A-Za-z0-9À-ÿ][\w+'’-]*(?:{_DOT}[\w+'’-]+)*\s?[\[(]at[\])]\s?{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}", re.I)
_SAID = rf"\s+{_UM}"
_EMAIL_SAID = re.compile(
    rf"\b[a-z0-9À-ÿ][\w'’]*(?:{_SAID}(?:dot|dash|hyphen|underscore|plus){_SAID}[a-z0-9À-ÿ][\w'’]*){{0,8}}{_SAID}at{_SAID}[a-z][\w]*(?:{_SAID}(?:dash|hyphen|dot){_SAID}[a-z0-9]\w*){{0,6}}{_SAID}dot{_SAID}[a-z]{{2,}}\b", re.I
)
_NUMERIC = re.compile(rf"(?<![\w.,/+])(?:[A-Z]{{1,2}}[ -]?(?={_UM}\d))?\+?\(?\d(?:(?:[ ()-]|\.(?![ \n])){{0,3}}{_UM}\d){{5,16}}(?:[ -]?[A-D]\b)?(?![\d/]|[.,]\d)", re.I)
_WORDS9 = "|".join([*DIGITS, "double", "triple", "treble"])
#: What a text must hold for spoken and written numbers and for streets; much cheaper than their patterns.
_DIGIT, _SAID_DIGITS, _TYPE = re.compile(r"\d"), re.compile(rf"\b(?:{_WORDS9})\b.{{0,12}}?\b(?:{_WORDS9})\b", re.S), re.compile(rf"\b(?:{'|'.join(STREETS)})\b")
_SPOKEN = re.compile(rf"\b(?:(?:[a-z]\s+)?(?:{_WORDS9}|plus))(?:[\s,-]+{_UM}(?:{_WORDS9})){{5,20}}\b", re.I)
_NUMBER_WORDS = rf"(?:(?:{'|'.join(_SMALL)}|a) hundred(?: and)?(?: (?:(?:{'|'.join(_TENS)})(?:[ -](?:{'|'.join(_SMALL[:9])}))?|{'|'.join(_SMALL)}))?|(?:{'|'.join(_TENS)})(?:[ -](?:{'|'.join(_SMALL[:9])}))?|{'|'.join(_SMALL)})"
_NAMEISH = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’-]*"
_STREET = re.compile(
    rf"(?<![\w.,/:])(?:(?:flat|apartment|apt|unit)\s+\d{{1,3}}[a-z]?,?\s+)?(?P<no>\d{{1,5}}[a-z]?|\b{_NUMBER_WORDS})(?P<gap>,?[ \t]+{_UM}(?:on\s+{_UM})?)(?!(?:{_NUMBER_WORDS})\b)(?P<name>(?:{_NAMEISH}[ \t]+{_UM}){{1,3}}?)(?P<type>{'|'.join(STREETS)})\b\.?", re.I
)
_FAMILY = r"(?:(?:van\s+der|van\s+den|van|von|de\s+la|de|del|di|da|le|la|el|al|bin|ibn|mac|mc|o)[\s'’]+)?[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’ø-]+"
_WORD = re.compile(r"[A-Za-zÀ-ÿ'’-]{2,}")
_FOLLOW = re.compile(rf"\s+{_UM}(?:(?P<mid>[A-Za-z])\.?\s+)?(?P<family>{_FAMILY})", re.I)
_LEAD = re.compile(rf"(?P<family>{_FAMILY})(?P<gap>,?\s+)(?:(?P<mid>[A-Za-z])\.?\s+)?$", re.I)
_TITLE = re.compile(rf"\b(?P<title>{'|'.join(TITLES)})\b\.?\s+{_UM}(?P<family>{_FAMILY})", re.I)
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÿ'’-]*[a-zß-ÿA-ZÀ-Þ]"
_PARTICLE = r"(?:(?:[Vv]an\s+[Dd]er|[Vv]an\s+[Dd]en|[Vv]an|[Vv]on|[Dd]e\s+la|[Dd]e|[Dd]el|[Dd]i|[Dd]a|[Ll]e|[Ll]a|[Ee]l|[Aa]l|[Bb]in|[Ii]bn)\s+)?"
#: Two capitalised words, in either order: whoever they are, the trees judge.
_PAIR = re.compile(rf"(?<![\w'’-])(?=(?P<a>{_CAPITAL})(?P<gap>,?[ \t]+){_UM}(?:(?P<mid>[A-Z])\.?[ \t]+)?(?P<b>{_PARTICLE}{_CAPITAL})(?![\w'’-]))")
#: Two words of any case where someone is introduced.
_INTRO = r"(?:name(?:'?s|’s| is)|called|named|known as|i am|i'm|i’m|im|this is|it's|it’s|spelt|signed|from)"
_INTRODUCED = re.compile(rf"\b{_INTRO}:?,?[ \t]+{_UM}(?P<a>[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’-]+)(?P<gap>,?[ \t]+){_UM}(?P<b>{_FAMILY})", re.I)


@lru_cache(1 << 17)
def fold(text: str) -> str:
    """Lower case without accents, so that spellings of a name meet."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).replace("ø", "o")


_GIVEN = frozenset(GIVEN)


@lru_cache(4)
def _ordinary(path: str) -> frozenset[str]:
    """Words of a public vocabulary that it has in lower case: entries that begin with a space. Those it has with a
    capital only, or far sooner with one, as names of persons and places, are there with a capital first."""
    rank: dict[str, int] = {}
    with open(path, "rb") as f:
        for line in f:
            token, at = line.split()
            b = base64.b64decode(token)
            if b[:1] == b" " and b[1:].isalpha() and b.isascii():
                rank[b[1:].decode()] = int(at)
    low = {w for w in rank if w.islower()}
    proper = {w for w in rank if w[:1].isupper() and w[1:].islower() and rank.get(w.lower(), 1 << 30) > 3 * rank[w]}
    return frozenset((low - {w.lower() for w in proper}) | proper)


def _near(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - 45) : start].lower(), text[end : end + 30].lower()


_PHONE_CUE = re.compile(r"\b(?:(?:tele)?phones?|call(?:s|ed|ing)?|ring(?:s|ing)?|rang|tel|text(?:s|ed)?|sms|mobile|landline|cell|reach|dial(?:led)?|number is|voicemail|extension|whatsapp)\b")
_ID_CUE = re.compile(r"\b(?:nhs|health|hospital|patient|nurse|passport|visa|upn|pupil (?:no|number|id)|learner|student (?:no|number|id)|national insurance|ni (?:no|number)|nino|ssn|social(?: security)?|payroll|payslip|tax|register(?:ed)?|insurance|unique|identity|id|reference)\b")
_MATHS_CUE = re.compile(r"\b(?:divisible|divided?|pattern|sequence|in words|round(?:ed)?|decimal|multipl\w+|plus|minus|times|digits?|numbers? line|equals?|sum|prime|factors?|goes|write|work out|add|subtract|square|total|answer|population|count)\b")
_MAIL_CUE = re.compile(r"\b(?:e-?mails?|log ?in|login|account|username|inbox|bounced|sign(?:ed)? up|mailto|contact|reach|address|write to|send|sent|message|mine)\b")
_HOME_CUE = re.compile(r"\b(?:lives?|living|address|moved?|house|home|deliver(?:y|ed)?|parcel|post(?:ed|code)?|come round|flat|send|number|visit|stay(?:ing|s)?|based|letter|form|next door|fire|certificate|nan's|address is)\b")
_NAME_CUE = re.compile(r"(?:\b(?:my|his|her|our|called|named|known as|this is|ask|tell|told|friend|cousin|brother|sister|neighbour|coach|tutor|for|hello|hi|hey|dear|signed|thanks|bye|i'm|i am|im|is|was|by|as|says|from|mum|dad|teacher|so|with|and|name)\b['’s]*[,:]?\s*)$")
_NOT_NAME_AFTER = re.compile(r"^\s*(?:street|road|lane|avenue|drive|close|way|diagram|theorem|triangle|bridge|park)\b")

FEATURES = {
    "email": ("at_sign", "bracketed", "spoken", "cue_before", "cue_after", "local_len", "local_digit", "local_parts", "local_ordinary", "domain_parts", "tld_len", "site_after", "first_short"),
    "number": ("digits", "plus", "zero_first", "letters_before", "letters_after", "seps", "groups", "spoken", "phone_before", "phone_after", "id_before", "id_after", "maths_before", "maths_after", "nhs_check", "ssn_shape", "national", "north_american", "upn_shape", "ni_shape", "pp_shape", "nines"),
    "address": ("in_words", "digits", "cue_before", "flat", "capital_name", "ordinary_name", "name_words", "short_type", "capital_type", "common_type", "cards_after", "maths_before", "comma", "number_word", "small_words", "on_gap", "unit_word", "home_after"),
    "name": ("title", "given_first", "given_last", "comma", "middle", "ordinary_family", "ordinary_given", "capital_family", "capital_given", "all_caps", "family_len", "cue_before", "street_after", "particle", "inner_mark", "title_first_of_and", "small_family", "digit_near", "proper_given", "proper_family", "unknown_given", "unknown_family", "introduced", "starts", "capital_after", "capital_before", "person_after", "given_follows", "thing_family"),
}


def _nhs(digits: str) -> bool:
    if len(digits) != 10:
        return False
    c = 11 - sum((10 - i) * int(d) for i, d in enumerate(digits[:9])) % 11
    return (0 if c == 11 else c) == int(digits[9])


def spoken_digits(text: str) -> str:
    out, times = "", 1
    for w in re.findall(r"[a-z]+", text.lower()):
        if w in ("double", "triple", "treble"):
            times = 2 if w == "double" else 3
        elif w in DIGITS:
            out += DIGITS[w] * times
            times = 1
    return out


def candidates(text: str, words: frozenset[str]) -> list[tuple[str, int, int, list[float]]]:
    """(family of kinds, start, end, features): every span that might be personal, overlaps and doubtful ones included."""
    out: list[tuple[str, int, int, list[float]]] = []
    low = text.lower()
    if "@" in text or "at" in low:
        for pattern in (_EMAIL, _EMAIL_SAID):
            if pattern is _EMAIL_SAID and "dot" not in low or pattern is _EMAIL and "@" not in text and "[at]" not in low and "(at)" not in low:
                continue
            for m in pattern.finditer(text):
                span = m[0]
                before, after = _near(text, m.start(), m.end())
                local, _, domain = re.sub(r"\s*(?:@|[\[(]at[\])]|\bat\b)\s*", "@", span, count=1, flags=re.I).partition("@")
                parts = re.split(r"[.+_-]|\s+(?:dot|dash|plus|underscore|hyphen)\s+", local.lower())
                labels = re.split(r"\.|\s*[\[(]dot[\])]\s*|\s+dot\s+", domain.lower())
                out.append(("email", m.start(), m.end(), [
                    "@" in span, "[" in span or "(" in span, pattern is _EMAIL_SAID, bool(_MAIL_CUE.search(before)), bool(_MAIL_CUE.search(after)), len(local), any(c.isdigit() for c in local), len(parts),
                    sum(p in words for p in parts) / len(parts), len(labels), len(labels[-1]), "website" in after or "web site" in after, len(parts) == 1 and len(local) <= 3,
                ]))
    found = [*([_NUMERIC] if _DIGIT.search(text) else []), *([_SPOKEN] if _SAID_DIGITS.search(low) else [])]
    if found:
        for pattern in found:
            # a short number just before another may be no part of it: both readings are candidates
            ends = [(m.start(), m.end()) for m in pattern.finditer(text)]
            ends += [(at + k.end(), end) for at, end in ends if pattern is _NUMERIC and (k := re.match(r"\d{1,3}[ .]+(?=[+(\d])", text[at:end]))]
            for at, end in ends:
                span = text[at:end].strip()
                said = pattern is _SPOKEN
                lead = 0
                if not said and re.match(r"(?i)(?:is|on|at|to|no|so|by|of|in|it|my|me|we|he|be|do|go|up|us|as|an|am|or|if|um|uh|er|hm|mm)[ -]", span):
                    lead = 3
                    span = span[3:].lstrip()
                head = re.match(r"[A-Za-z]+", span) if not said else None
                core = re.sub(r"(?i)\b(?:u+[hm]+|e+r+m*|h?m+)\b", "", span)
                digits = spoken_digits(span) if said else re.sub(r"\D", "", core)
                before, after = _near(text, at + lead, end)
                close = before[-28:]
                groups = [len(g) for g in re.findall(r"\d+", core)]
                tail = not said and span[-1].isalpha()
                out.append(("number", at + lead, at + len(text[at:end].rstrip()), [
                    len(digits), "+" in span, digits[:1] == "0", len(head[0]) if head else 0, tail, len(re.findall(r"[ ().-]+", span)) if not said else 0, len(groups), said,
                    bool(_PHONE_CUE.search(close)), bool(_PHONE_CUE.search(after)), bool(_ID_CUE.search(before)), bool(_ID_CUE.search(after)),
                    bool(_MATHS_CUE.search(close[-18:])), bool(_MATHS_CUE.search(after[:22]) or "and so on" in after), _nhs(digits), groups == [3, 2, 4] and not head,
                    bool(re.match(r"(?:0044|44|0)0?(?:7\d{9}|[123]\d{8,9}|8\d{8,9})$|(?:61|0)0?4\d{8}$", digits)), bool(re.match(r"1?[2-9]\d\d[2-9]\d{6}$", digits)) and groups[-1:] == [4],
                    bool(head) and len(head[0]) == 1 and len(digits) in (12, 13), bool(head) and len(head[0]) == 2 and len(digits) == 6 and tail, (bool(head) and len(head[0]) <= 2 and len(digits) == 7) or (not head and len(digits) == 9), digits.startswith("999"),
                ]))
    for m in _STREET.finditer(text) if _TYPE.search(low) else ():
        before, after = _near(text, m.start(), m.end())
        name, kind = m["name"].split(), m["type"]
        core = [w for w in name if fold(w) not in ("old", "great", "upper", "lower", "saint", "st", "new", "little", "north", "south", "east", "west")] or name
        plain = [fold(w) in words for w in core]
        out.append(("address", m.start(), m.end(), [
            not m["no"][0].isdigit(), len(re.sub(r"\D", "", m["no"])), bool(_HOME_CUE.search(before[-30:])), m[0].lower().startswith(("flat", "apart", "apt", "unit")), sum(w[0].isupper() for w in core) / len(core), sum(plain) / len(plain), len(name),
            kind.lower() in ("st", "rd", "ave", "ln", "dr", "cl", "ct", "pl", "gdns", "cres", "terr", "blvd", "sq"), kind[0].isupper(), kind.lower() in ("square", "place", "way", "close", "walk", "row", "rise", "hill", "green", "view", "yard", "drive", "road"),
            bool(re.match(r"\s*(?:cards?|tiles?|tokens?|counters?|points?|games?|badges?|maps?|values?|has|have|number|of|to|and then)\b", after)), bool(_MATHS_CUE.search(before[-15:])), "," in m["gap"], bool(re.search(r"\bnumber\s*$", before)),
            any(fold(w) in ("the", "of", "to", "and", "is", "a", "in", "on", "then", "for", "that", "at", "by", "i", "you", "we", "it", "times", "houses", "minutes", "minute", "km", "m", "by") for w in name), bool(re.search(r"\bon\b", m["gap"])), fold(name[0]) in ("minute", "minutes", "km", "cm", "m", "mm", "times", "pupils", "people"),
            bool(_HOME_CUE.search(after)),
        ]))

    def named(start: int, end: int, given: str, family: str, title: bool, comma: bool, middle: bool, last: bool, follows_and: bool = False) -> None:
        before, after = _near(text, start, end)
        words_f = [w for w in re.split(r"[\s'’-]+", fold(family)) if w]
        core = max(words_f, key=len) if words_f else ""
        caps = [c for c in family if c.isalpha()]
        out.append(("name", start, end, [
            title, fold(given) in _GIVEN and not last, fold(given) in _GIVEN and last, comma, middle, core in words, fold(given) in words, bool(caps) and family.split()[-1][0].isupper(), bool(given) and given[0].isupper(), bool(caps) and family.isupper(),
            len(core), bool(_NAME_CUE.search(before)), bool(_NOT_NAME_AFTER.match(after)), len(words_f) > 1, bool(re.search(r"['’-]", family)), follows_and, core in _TINY, bool(re.search(r"\d\s*$", before)),
            fold(given).capitalize() in words, core.capitalize() in words, not known_word(given), not known_word(core), bool(_INTRO_END.search(before)), start == 0 or bool(re.search(r"[.!?:;\n-]\s*$", before)),
            bool(re.match(r"\s+[A-Z][a-z]", text[end : end + 8])), bool(re.search(r"[A-Z][a-z]+\s+$", text[max(0, start - 20) : start])), bool(_PERSON_AFTER.match(after)), fold(family) in _GIVEN, core in _THINGS,
        ]))

    def known_word(w: str) -> bool:
        x = fold(w)
        return x in words or x.capitalize() in words or x.rstrip("s") in words

    seen: set[tuple[int, int]] = set()
    for m in _TITLE.finditer(text):
        named(m.start(), m.end(), m["title"], m["family"], True, False, False, False, fold(m["family"]) == "and")
    for pattern in (_PAIR, _INTRODUCED):
        for m in pattern.finditer(text):
            a, b = m["a"], m["b"]
            if fold(a) in TITLES or (m.start("a"), m.end("b")) in seen or _HESITATION.fullmatch(fold(a)) or _HESITATION.fullmatch(fold(b).split()[-1]):
                continue
            seen.add((m.start("a"), m.end("b")))
            comma = "," in m["gap"]
            last = comma or (fold(b) in _GIVEN and fold(a) not in _GIVEN)
            named(m.start("a"), m.end("b"), b if last else a, a if last else b, False, comma, pattern is _PAIR and bool(m["mid"]), last)
    for m in _WORD.finditer(text):
        w = fold(m[0])
        w = w[:-2] if w.endswith(("'s", "’s")) else w
        if w not in _GIVEN:
            continue
        follow = _FOLLOW.match(text, m.end())
        if follow and (m.start(), follow.end()) not in seen and not _HESITATION.fullmatch(fold(follow["family"])):
            named(m.start(), follow.end(), m[0], follow["family"], False, False, bool(follow["mid"]), False)
        lead = _LEAD.search(text[max(0, m.start() - 40) : m.start()])
        if lead and not _HESITATION.fullmatch(fold(lead["family"]).split()[-1]):
            at = max(0, m.start() - 40) + lead.start()
            if (at, m.end()) in seen:
                continue
            named(at, m.end(), m[0], lead["family"], False, "," in lead["gap"], False, True)
    return out


_HESITATION = re.compile(r"(?:u-?)*(?:u*h?m+|u+h+m*)|e+r+m*|h+m+|m+")
_TINY = frozenset("a i the is and to you he she it we in on at so of my me let has got an or if be by do go who how was what can er um uh yes no not are did has can will".split())
_INTRO_END = re.compile(rf"\b{_INTRO}:?,?\s+(?:um+|uh+|er+m*)?,?\s*$")
#: What people do, right after their name, and what things with capitals are called.
_PERSON_AFTER = re.compile(r"['’]?s?,?\s+(?:speaking|says?|said|told|asked|thinks?|gave|marked|wants?|helped|showed|lives?|has|had|is|was|can|will|and i|here|in my)\b")
_THINGS = frozenset("stage year term diagram theorem chart game book street road lane bridge park city town county island river school academy college university class classroom team club cup league north south east west kingdom states sea ocean mountain museum station hall church hotel form test exam paper sheet page set unit level question section part time day week month morning afternoon evening angle triangle square circle graph line number method rule law board pen point scale axis factor multiple".split())
_DETECTORS: dict[tuple[int, int], dict[str, Boosted]] = {}


def fitted(samples: int = 16000, seed: int = 5, vocabulary: str = VOCABULARY) -> dict[str, Boosted]:
    """A model for each kind, trained on so many invented utterances (a bounded set) and calibrated on others."""
    from chalkstream.llm.utterance_samples import labelled

    if (samples, seed) not in _DETECTORS:
        words = _ordinary(vocabulary)
        rows: dict[str, list[tuple[list[float], int, bool]]] = {k: [] for k in KINDS}
        for n, (text, spans) in enumerate(labelled(samples, seed)):
            for family, a, b, x in candidates(text, words):
                for kind in ("phone", "id_number") if family == "number" else (family,):
                    hit = any(k == kind and min(b, e) - max(a, s) > 0.6 * max(b - a, e - s) for k, s, e in spans)
                    rows[kind].append((x, int(hit), n % 4 == 0))
        _DETECTORS[samples, seed] = {}
        for kind, own in rows.items():
            x, y, held = (np.array([r[i] for r in own], float) for i in range(3))
            held = held.astype(bool)
            _DETECTORS[samples, seed][kind] = Boosted(depth=4).fit(x[~held], y[~held]).calibrate(x[held], y[held])
    return _DETECTORS[samples, seed]


def gate(text: Column) -> Column:
    """True for every text candidates() finds anything in that could be accepted; in the JVM, without Python.

    The patterns begin with a class of characters where they can, and look behind only after it, which keeps the search
    fast where nothing is found.
    """
    given = _trie(sorted((_GIVEN - {"asa"}) | {"bj[öÖ]rk", "jos[éÉ]", "ren[éÉ]e", "si[âÂ]n", "zo[ëË]", "asa"})) + "|[åÅ]sa"
    streets = "|".join(sorted(STREETS))
    tails = "|".join(sorted({w[1:] for w in (*_SMALL, *_TENS, "hundred")}))
    on_street = rf",?\s+(?:[\p{{L}}.,'’-]+\s+){{1,6}}?(?:{streets})\b"
    parts = [
        text.contains("@"),
        text.rlike(f"[{ODD_SPACES}]"),  # which the patterns below take for no space
        text.rlike(r"(?i)[\[(]at[\])]|\bat\s+(?:\S+\s+){1,9}dot\s"),
        text.rlike(r"\d(?:[ ().-]{0,3}(?:\p{L}+[.,]*\s)?\d){5}"),
        text.rlike(rf"[zZoOtTfFsSeEnNdD](?<!\p{{L}}.)(?i:ero|ought|h|ne|wo|hree|our|ive|ix|even|ight|ine|ouble|riple|reble)?[\s,-]+(?:[uehmrUEHMR-]+[.,]*\s+)?(?:(?i:{_WORDS9})[\s,-]+(?:[uehmrUEHMR-]+[.,]*\s+)?){{4}}"),
        text.rlike(rf"\d(?i)[a-z]?{on_street}"),
        text.rlike(rf"[oOtTfFsSeEnNhH](?<!\p{{L}}.)(?i)(?:{tails}){on_street}"),
        text.rlike(r"(?i)(?:\A|[^\p{L}])(?:m(?:r|rs|s|iss|x|adam)|dr|prof(?:essor)?|sir)\b\.?\s+\p{L}"),
        text.rlike(rf"(?i)(?:\A|[^\p{{L}}])(?:{given})(?:['’]s)?,?\s+\p{{L}}"),
        text.rlike(rf",(?i)\s+(?:{given})(?!\p{{L}})"),
        text.rlike(r"\p{Lu}(?<![\p{L}'’-].)[\p{L}'’-]+,?[ \t]+(?:(?i:u?h?m+|er+m*|u-?um)[.,]*[ \t]+)?(?:\p{Lu}\.?[ \t]+|[vdlaebi][a-z]{0,2}[ \t]+){0,2}\p{Lu}[\p{L}'’-]"),
        text.rlike(r"(?i)\b(?:name(?:['’]?s| is)|called|named|known as|signed|i['’]?m|i am|this is|spelt)\b:?,?[ \t]+\p{L}+,?[ \t]+\p{L}"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return F.coalesce(out, F.lit(False))


def _trie(words: list[str]) -> str:
    """One pattern for a sorted list of words that tries each first letter once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    return "|".join(k + (f"(?:{'|'.join(v)})" if len(v) > 1 else v[0]) for k, v in by.items() if k)


def spans_of(texts: list[str], models: dict[str, Boosted], words: frozenset[str]) -> list[list[tuple[int, int, str, float]]]:
    """For each text its accepted spans (start, end, kind, score), none overlapping, by position.

    Of overlapping spans the one of the highest score stays, of ties the longer, then the earlier.
    """
    found = [(i, *c) for i, t in enumerate(texts) for c in candidates(t, words)]
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    judged: list[tuple[int, int, int, str, float]] = []
    for family, kinds in (("email", ("email",)), ("number", ("phone", "id_number")), ("address", ("address",)), ("name", ("name",))):
        own = [f for f in found if f[1] == family]
        if not own:
            continue
        x = np.array([f[4] for f in own], float)
        for kind in kinds:
            s = models[kind].score(x)
            judged += [(f[0], f[2], f[3], kind, float(p)) for f, p in zip(own, s) if p >= models[kind].threshold]
    for i, a, b, kind, p in sorted(judged, key=lambda j: (-j[4], j[1] - j[2], j[1])):
        if all(b <= s or a >= e for s, e, _, _ in out[i]):
            out[i].append((a, b, kind, p))
    return [sorted(o) for o in out]


def personal_spans(rows: DataFrame, text: str, vocabulary: str = VOCABULARY, samples: int = 16000) -> DataFrame:
    """rows with spans: array of struct(start, end, kind, score), where a text names a person or how to reach or know one.

    Only texts that pass gate() go to Python; all others, and null texts, get an empty array. start is 0-based, end
    exclusive, in code points. Kinds: email, phone, id_number, address, name. Ordinary words are those of vocabulary.
    Other columns stay as they are, but a column named spans is replaced. An empty table stays empty.
    """
    models = fitted(samples, vocabulary=vocabulary)

    own = [c for c in rows.columns if c != "spans"]
    marked = rows.select(*[F.col(f"`{c}`") for c in own], gate(F.col(f"`{text}`")).alias("__in"))
    empty = marked.where("not __in").select(*[F.col(f"`{c}`") for c in own], F.array().cast(SPANS).alias("spans"))
    schema = T.StructType([*[rows.schema[c] for c in own], T.StructField("spans", T._parse_datatype_string(SPANS))])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _ordinary(vocabulary)
        for b in batches:
            found = spans_of(list(b[text]), models, words)
            yield b.assign(spans=pd.Series([[{"start": a, "end": e, "kind": k, "score": p} for a, e, k, p in o] for o in found], index=b.index, dtype=object))

    return marked.where("__in").select(*[F.col(f"`{c}`") for c in own]).mapInPandas(judge, schema).unionByName(empty)


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its placeholder, such as [EMAIL]; the words between are kept as they are."""
    step = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at")),
    )
    return F.when(F.size(spans) > 0, F.concat(step["out"], F.substr(text, step["at"] + 1))).otherwise(text)
