"""Abbreviations whose period does not end a sentence, by language, and the patterns made of them."""

from __future__ import annotations

import re
import string

# Results depend on these very words.
_EN = """
Mr Mrs Ms Dr Prof Sr Jr St Rev Gen Gov Sgt Cpl Pvt Capt Lt Col Maj Cmdr Adm
Fig Figs Eq Eqs Ref Refs Tab Sec Ch Vol No Nos Ed Eds Trans Dept Thm Lem Prop Def Cor Rem Ex
al approx ca cf etc et ibid viz vs misc est govt dept univ inc corp ltd Ave Blvd Rd
Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec Mon Tue Wed Thu Fri Sat Sun pp pg pt pts
"""
_DE = """
Hr Fr Dr Prof Abb Bd Hrsg Kap Nr S Verl Aufl Jg Anm Anh Beil Tab Gl Abschn Bsp Str Pl bzw ca etc evtl ggf vgl usw
Jan Feb Apr Jun Jul Aug Sep Okt Nov Dez
"""
_FR = "M Mme Mlle Dr Prof Me fig eq chap vol p pp ed trad n t av apr env cf etc janv fevr avr juil sept oct nov dec"
_IS = "Hr Fr Dr sbr frk sk nr jan feb mar apr jun jul aug sep okt nov des"
_PL = "dr mgr prof doc rys tab wyd red t s nr poz zob por ul al pl os sty lut mar kwi maj cze lip sie wrz paz lis gru"

#: One period after a word.
WORDS = {lang: (*words.split(), *string.ascii_uppercase) for lang, words in {"en": _EN, "de": _DE, "fr": _FR, "is": _IS, "pl": _PL}.items()}
#: A period inside as well. Fixed values.
DOTTED = {
    "en": ("e.g", "i.e", "a.m", "p.m", "v.s"),
    "de": ("z.B", "d.h", "u.a", "o.g", "s.o", "u.U"),
    "fr": ("c.-a-d", "p.ex"),
    "is": ("m.a", "o.fl"),
    "pl": ("m.in", "t.j", "j.w", "t.zw", "b.r"),
}
LANGS = tuple(WORDS)


def language(lang: str | None) -> str:
    """The language whose list holds: unknown ones take the English list."""
    return lang if lang in WORDS else "en"


def tail_pattern(lang: str | None) -> str:
    """A segment, without white space at its end, that ends in an abbreviation; for Java's and Python's engines."""
    lang = language(lang)
    words = "|".join(WORDS[lang])
    dotted = "|".join(re.escape(x) for x in DOTTED[lang])
    return rf"""(?U)(?:(?:^|[\s"'`(\[])(?:{words})|(?:^|\s)(?:{dotted}))\.\z"""
