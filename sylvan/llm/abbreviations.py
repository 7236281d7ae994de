"""Abbreviations by language, and the language of a paragraph.

A full stop after an abbreviation ends no sentence, but what is an abbreviation in one language is
a word in another (*no*, *me*, *art*), so each paragraph is judged by the list of its own language
only. Latin script is told apart by function words, first in the paragraph, then in the whole text;
other scripts by their letters.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

#: Abbreviations that always stand before more of their sentence, by language.
NEVER = {
    "en": "dr mr mrs ms messrs prof st gen col sgt capt lt rev hon gov sen rep mt ft vs cf e.g i.e viz approx ca c al eq ed eds",
    "de": "dr prof z.b d.h u.a o.ä v.a s.o s.u z.t i.d.r evtl ggf inkl exkl ca bzw vgl hr fr frau dipl ing geb str sog z d u",
    "fr": "dr prof m mme mmes mlle mlles mgr env réf p.ex c.-à-d av bd cf éd",
    "es": "dr dra prof sr sra srta sres d dña ee p.ej ej aprox av dpto ud uds lic ing véase tel",
    "it": "dr dott prof sig sigg ecc es pag cfr",
    "pt": "dr dra prof sr sra ex aprox av",
    "nl": "dr prof dhr mevr bijv d.w.z o.a",
    "ru": "им ок см т т.е т.т т.п т.н напр акад проф доц ул пл просп тел е св тов",
    "el": "κ κα κ.κ π.χ βλ πίν δηλ δρ καθ λεωφ οδ τ.μ χλμ πρβλ ο.π",
    "ar": "د أ م ه",
    "hi": "डॉ श्री प्रो",
    "th": "ดร พ.ศ ค.ศ มม ซม กม นาย อ จ ต ถ",
}
#: Abbreviations that stand before a number, by language.
NUMBERED = {
    "en": "no nos fig figs sec ch vol pp p art op para tab",
    "de": "nr abb s bd kap art abs tab ziff",
    "fr": "n no fig p pp art ex chap vol tab",
    "es": "pág págs p núm no art cap fig vol",
    "it": "n p pp art fig cap vol",
    "pt": "n p pp art fig cap vol pág",
    "nl": "nr blz art afb fig",
    "ru": "рис табл стр гл ст т.д",
    "el": "σελ αρ αριθ εικ κεφ",
    "ar": "ص ج ت",
    "hi": "सं पृ",
    "th": "",
}
#: Those that are also words of the language itself.
WORDS = {
    "en": "no nos fig figs sec art op para gen col rep rev hon mt ed al tab",
    "de": "art",
    "fr": "art env",
    "es": "no",
    "it": "es",
    "pt": "no",
}
#: Abbreviations that may stand at a sentence's end; then a capital must follow.
MAYBE = {
    "en": "inc ltd co corp llc plc jr sr etc a.m p.m am pm u.s u.k u.n u dept est ave blvd",
    "de": "usw usf etc u std e.u",
    "fr": "etc",
    "es": "etc u",
    "it": "ecc",
    "pt": "etc",
    "nl": "enz",
    "ru": "г гг в вв руб коп млн млрд тыс чел гр",
    "el": "χιλ δρχ ευρ ημ",
}
#: Units, in every language that writes them in Latin or its own letters.
UNITS = "h kg km cm mm min уу uu"
#: German month names, after a day's ordinal number.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jan feb mrz apr jun jul aug sep sept okt nov dez"
#: Frequent function words by which languages in Latin script are told apart.
FUNCTION = {
    "en": "the of and to in is was for with that it on as be are this by not he she they we you his her from have had who its a an my me i or but said at has been after before which then no nobody",
    "de": "der die das und ist nicht ein eine mit von zu den dem auf für im des sich war wurde nach bei auch es wird sind einen einer er sie am vom zum zur in dass oder ob bis muss",
    "fr": "le la les des est une dans pour que qui sur pas avec au du et ne se ce était par il elle un de en sans où à l d sont ont être plus",
    "es": "el la los las es una en para que por con del no se su al lo como más fue un de y está son muy sin",
    "it": "il di che è una per non con del della sono gli un la e era nel dal in",
    "pt": "o os uma em não com para que do da dos das foi ao um de e era no na",
    "nl": "de het een van en niet met op zijn voor was is dat naar bij in",
}
#: Words that make a clause, so that a line holding one is no title.
CLAUSE = {
    "en": "is are was were be been has have had do does did will would can could must should may might it he she they we you i that which who whose when where why how what if although though because while once unless but not there then took",
    "de": "ist sind war waren wird werden wurde wurden hat haben hatte muss müssen kann können soll er sie es wir ich man dass weil wenn ob obwohl während nachdem warum wie was wer nicht aber",
    "fr": "est sont était étaient ont sera fut semble semblait doit peut il elle ils elles on nous vous je qui que quand si parce pourquoi comment ne pas mais",
    "es": "es son era eran está están fue ha han hay debe puede parece sigue él ella que cuando si porque cómo qué no pero",
    "it": "è sono era ha hanno che quando se perché non ma",
    "pt": "é são era está foi tem que quando se porque não mas",
    "nl": "is zijn was waren wordt heeft dat als omdat niet maar er",
    "ru": "есть был была было были будет не что если когда почему как он она они мы но",
    "el": "είναι ήταν έχει δεν θα να που όταν αν γιατί πώς αλλά",
}
_LATIN = re.compile(r"[a-zà-öø-ÿœ]+")


def _fold(x: str) -> str:
    from sylvan.llm.sentences import _folding

    return x.translate(_folding()[0]).lower()


class Language:
    """The abbreviations of one language, or of several joined by a plus sign, folded as texts are."""

    def __init__(self, name: str):
        def of(kind: dict[str, str]) -> frozenset[str]:
            return frozenset(_fold(x) for part in name.split("+") for x in kind.get(part, "").split())

        self.name = name
        self.never, self.numbered, self.words = of(NEVER), of(NUMBERED), of(WORDS)
        self.maybe = of(MAYBE) | (frozenset(_fold(x) for x in UNITS.split()) if name else frozenset())
        self.starters = of(FUNCTION)
        self.clause = of(CLAUSE)
        self.months = frozenset(_fold(x) for x in MONTHS.split()) if name else frozenset()


@lru_cache(maxsize=32)
def language(name: str) -> Language:
    return Language(name)


#: No language: nothing is an abbreviation.
NONE = Language("")


@lru_cache(maxsize=1)
def every() -> frozenset[str]:
    """Abbreviations of any language; only for these must a paragraph's language be known."""
    all_ = language("+".join({*NEVER, *NUMBERED, *MAYBE}))
    return all_.never | all_.numbered | all_.maybe


@lru_cache(maxsize=1)
def _votes() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, words in FUNCTION.items():
        for w in words.split():
            out.setdefault(_fold(w), []).append(name)
    return out


def latin_language(folded: str) -> str | None:
    """The language of a text in Latin script by its function words, None without any. A word of
    several languages counts for each in part."""
    score: Counter = Counter()
    votes = _votes()
    for w, n in Counter(_LATIN.findall(folded.lower())).items():
        for name in votes.get(w, ()):
            score[name] += n / len(votes[w])
    if "ß" in folded or "ä" in folded or "ö" in folded:
        score["de"] += 1
    if "ñ" in folded or "¿" in folded or "¡" in folded:
        score["es"] += 1
    if "è" in folded or "ê" in folded or "œ" in folded:
        score["fr"] += 1
    return max(score, key=lambda x: (score[x], x)) if score else None


#: Scripts other than Latin, and the language whose abbreviations they are judged by.
_SCRIPTS = {
    "ru": re.compile("[\u0400-\u052f]"),
    "el": re.compile("[\u0370-\u03ff\u1f00-\u1fff]"),
    "ar": re.compile("[\u0600-\u06ff]"),
    "hi": re.compile("[\u0900-\u097f]"),
    "th": re.compile("[\u0e00-\u0e7f]"),
    "ja": re.compile("[\u3040-\u30ff\u3400-\u9fff\uff66-\uff9d]"),
    "am": re.compile("[\u1200-\u137f]"),
}


def script_language(token: str) -> str | None:
    """The language whose abbreviations a folded token in a script other than Latin is judged by."""
    return next((name for name, script in _SCRIPTS.items() if script.search(token)), None) if not token.isascii() else None


def main_language(f: str) -> str | None:
    """The language of a folded paragraph; a script other than Latin that holds much of it decides
    for it, with the English list for its Latin words. About half of the Cyrillic and Greek letters
    fold to Latin ones, and a Latin text keeps none of either."""
    if not f.isascii():
        count = {name: len(script.findall(f)) * (6 if name in ("ru", "el") else 2) for name, script in _SCRIPTS.items()}
        most = max(count, key=count.__getitem__)
        if count[most] > sum(map(len, _LATIN.findall(f.lower()))):
            return f"{most}+en"
    return latin_language(f)


class Speech:
    """Languages of one folded text, found when first asked for."""

    def __init__(self, f: str):
        self.f = f
        self.whole: str | None = None
        self.at: dict[int, str] = {}

    def of(self, a: int, b: int, s: int, e: int) -> Language:
        """The language that judges the token ``[s, e)`` of the paragraph ``[a, b)``: its script's,
        or the paragraph's, or the text's, or any, as far as each can be told."""
        name = script_language(self.f[s:e])
        if name is None:
            name = self.at.get(a)
            if name is None:
                name = main_language(self.f[a:b])
                if name is None:
                    if self.whole is None:
                        self.whole = main_language(self.f) or "+".join(FUNCTION)
                    name = self.whole
                self.at[a] = name
        return language(name)
