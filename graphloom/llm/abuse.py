"""Scores for abusive, hateful or sexually explicit language.

Method: words are freed from disguises (look-alike letters, digits and signs for letters, stretched or spaced
letters, invisible characters, words broken over lines, wrong decoding). A compiled Levenshtein automaton is
intersected with the lexicon's trie, so misspelled terms are caught. Terms carry roles; the window of words around
a term gives its features: which roles stand together, whether the term is spelled right, which runs of words the
labelled documents have made suspect. A passage's score is a logistic function of these; its weights are fitted on
labelled documents around given ones, so without labels the given ones hold. Quotation marks around the passage
tell quoted abuse from the author's own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.session import cut

#: Words on either side that count as the context of a term.
WINDOW = 11
#: A document at or above this score is a case.
THRESHOLD = 0.5
#: Labelled documents that the weights are fitted on, at most; runs of words kept, documents that a run must stand in.
LABELLED, RUNS, SUPPORT = 20_000, 50_000, 3
#: Words of a run, and standard errors that its log odds are lowered by.
RUN_WORDS, SURE = (2, 3, 4), 3.0
#: How firmly the given weights hold against the labels.
FIRMNESS = 2.0

# Roles. SLUR: abuse by itself. WEAK: abuse if aimed at a person. GROUP with DEHUMAN or WEAK: hatred.
# HARM: a wish or threat if aimed at a person or group, the more with SELF, the one addressed. LEWD: explicit with a person or another such word.
# FAULT: the word is a term only if a spelling fault is allowed.
SLUR, WEAK, PERSON, GROUP, DEHUMAN, HARM, LEWD, BODY, SELF, FAULT = (1 << i for i in range(10))

_RU_NOUN = ["", "а", "у", "ом", "е", "ы", "и", "ов", "ам", "ами", "ах", "ой"]
_RU_SOFT = ["ь", "и", "ью", "ей", "ям", "ями", "ях", "я", "ю", "ем"]
_RU_FEM = ["а", "ы", "е", "у", "ой", "ам", "ами", "ах", "и", ""]
_RU_ADJ = ["ый", "ий", "ой", "ая", "яя", "ое", "ее", "ые", "ие", "ого", "его", "ому", "ему", "ым", "им", "ом", "ем", "ую", "юю", "ых", "их", "ыми", "ими"]
_EN = ["", "s", "es"]
_DE = ["", "e", "en", "er", "es", "s", "n", "em"]

#: (roles, endings, stems): the lexicon, written out by rule.
_TERMS: list[tuple[int, list[str], str]] = [
    (SLUR, _RU_NOUN, "идиот дебил кретин ублюд выродок придур недоум урод имбецил дегенерат мудак мудил подон дурак болван козёл олух засранец гондон долбоёб уёб чмошник отмороз лох скот"),
    (SLUR, _RU_NOUN, "идиотк ублюдок ублюдк придурок придурк недоумок недоумк подонок подонк выродк отморозок отморозк дурачок мудозвон говнюк ушлепок ушлепк упырь сучонок сучк"),
    (SLUR, _RU_SOFT, "мраз твар сволоч дрян падал"),
    (SLUR, _RU_FEM, "гнид скотин тупиц сволот паскуд шалав мразот пидорас педик пидор гадин сук дур шлюх падл свинь"),
    (SLUR, ["о", "а", "у", "ом", "е"], "ничтожеств чм говн быдл дерьм"),
    (SLUR, ["е", "я", "ю", "ем", "и"], "отребь"),
    (SLUR, [""], "мразина сволочью"),
    (SLUR, _EN, "idiot moron imbecile cretin bastard scumbag halfwit dumbass jackass dipshit asshole arsehole shithead fuckhead fuckwit motherfucker dickhead douchebag cunt twat bitch whore wanker nitwit dimwit numbskull lowlife faggot nigger retard slut dumbfuck fucker bellend tosser simpleton"),
    (SLUR, _DE, "idiot vollidiot trottel volltrottel mistkerl dreckskerl schwachkopf arschloch wichser hurensohn hure fotze abschaum dummkopf missgeburt drecksau schlampe vollpfosten spasti penner depp drecksack miststück arschgeige hohlkopf"),
    (SLUR, ["löcher"], "arsch"),
    (WEAK, _RU_ADJ, "туп глуп безмозгл никчемн никчёмн жалк бездарн убог мерзк вонюч низш полоумн"),
    (WEAK, _RU_NOUN, "помойк помойн мусор отброс дерьмов кретинск позорищ"),
    (WEAK, ["", "ly", "er", "est", "s", "y"], "stupid dumb worthless pathetic braindead brain useless disgusting shit crap garbage trash brainless filthy inferior rotted rotten scum"),
    (WEAK, _DE, "dumm blöd widerlich nutzlos erbärmlich minderwertig dreck mist scheisse unfähig"),
    (PERSON, [""], "you your yours yourself he she his her him who author owner developer accountant tester analyst boss colleague secretary girl girls guy man woman wife mother i me my we"),
    (PERSON, [""], "ты тебя тебе тобой твой твоя твои твою твоё твоего твоим вы вас вам ваш ваша ваши он она его её ее ему ей им них автор автора автору автором авторов разработчик разработчика бухгалтер бухгалтеру бухгалтера начальник начальника коллега коллеги аналитик администратор кто кого тем я мне меня мной мной"),
    (PERSON, [""], "секретарша секретаршей секретарше секретаршу кладовщица кладовщице кладовщицу кладовщицей соседка соседку соседкой соседки директор директора программист программиста начальница девушка девушки жена женой муж мужик"),
    (PERSON, [""], "du dich dir dein deine deinen deinem deiner ihr euch sie er wer mich mir ich autor kollege kollegin chef chefin sekretärin entwickler buchhalter eltern mutter"),
    (GROUP, [""], "immigrant immigrants migrants refugees refugee foreigners foreigner women woman females disabled cripples blacks jews muslims gays lesbians gypsies arabs asians folks elderly pensioners villagers peasants homosexuals mexicans africans chinese russians ukrainians poles turks"),
    (GROUP, _RU_NOUN, "мигрант иммигрант беженц инвалид иностранц приезж баб старик старух женщин девк евре цыган мусульман гомосексуал таджик узбек кавказ негр азиат калек пенсионер татар армян грузин"),
    (GROUP, [""], "иностранцы иностранцев иностранцам беженцы беженцев беженцам бабы баб бабам старики деревенские деревенских деревенским приезжие приезжих приезжим геи геев лесбиянки чурки чурок хачи хачей хохлы кацапы жиды жидов евреи евреев негры цыгане кавказцы понаехавшие черные чёрные хромые"),
    (GROUP, _DE, "ausländer flüchtling migrant einwanderer jude türke zigeuner frau weib behindert rentner schwul schwarz asylant moslem muslim araber pole russe alte"),
    (DEHUMAN, [""], "vermin subhuman subhumans plague parasites parasite animals animal rats rat cockroaches cockroach burden scum filth dirt savages inferior cages cage deport exterminate gassed stupid trash garbage disease cancer pigs apes monkeys"),
    (DEHUMAN, _RU_NOUN, "паразит крыс нелюд животн таракан мусор зараз клетк грязь грязи скот недочеловек чум отброс обуз саранч обезьян"),
    (DEHUMAN, [""], "нелюди грязью низшие низших вымирают вымрут вымирать сдохнуть гнать выгнать вышвырнуть избавиться истребить уничтожить депортировать жрут выселить клетке клетку"),
    (DEHUMAN, _DE, "ungeziefer parasit untermensch ratte abschaum pest tier schmarotzer dreck käfig minderwertig plage vieh"),
    (DEHUMAN, [""], "hinausgeworfen rausgeworfen rauswerfen ausrotten vergasen abschieben"),
    (HARM, [""], "drown hang starve choke strangle murder strangled hanged burnt shot beaten slaughter hell"),
    (HARM, [""], "сдох сдохни сдохнуть сдохнешь сдохните повесься утопись удавись застрелись убейся удавить придушить задушить зарезать зарежу убью убить прибью прикончить урою закопаю оторвать отрубить переломать сломаю сжечь расстрелять повесить издохни сгори изуродую"),
    (HARM, [""], "verrecke verrecken verreck erhänge ersäuf abstechen umbringen abknallen totschlagen erschiessen aufhängen vergasen umbringe abknalle"),
    (LEWD, [""], "sex porn porno pornographic naked nude nudes topless nipples moaned moans moaning licked licking undress undressed threesome oral blowjob handjob orgasm horny masturbate masturbating erotic penis vagina cock pussy tits boobs clit dildo orgy cum creampie fucked fucking fuck strip stripped selfies rides"),
    (LEWD, [""], "порно порнуха секс сексом секса сексе трахнуть трахать трахает трахался трахаться трахни сиськи сисек сиськами сиську кончаю кончает кончил кончила стонет стонала стонать стонут догола голые голая голую голой голых голышом обнажённая обнажённые интимные интимных интим ласкает ласкать ласкала раздеть раздевается раздевайся раздевалась раздену белья оргазм оральный минет отсос отсосать член члене хуй хуя пизда пизды ебать ебал ебёт ебля выебать соски сосок соска мастурбирует мастурбировать дрочит дрочить эротика эротические шлюха лизать лижет возбуждена голенькая"),
    (LEWD | BODY, [""], "threesome topless nipples blowjob handjob orgasm masturbating creampie tits pussy cock moaned licked сиськи сисек сиськами трахнуть трахать кончаю минет отсос ебать выебать мастурбирует дрочит догола нагишом голышом ficken fick nacktbilder nacktfotos titten wichsen orgasmus порнуха"),
    (LEWD, [""], "nackt nackte nackten nacktbilder nacktfotos nacktbild ficken fick fickt gefickt bumsen vögeln titten brüste schwanz muschi porno sex blasen wichsen orgasmus geil geile stöhnt stöhnte ausziehen auszieht nippel"),
    (BODY, [""], "bed desk floor breast breasts grudy body грудь груди грудью попу попа попку попка коленях колени ночь ночью ночами столе кровати постели камеру bett busen hintern"),
    (SLUR, [""], "сдохни сдохните издохни повесься повесьтесь утопись утопитесь удавись застрелись убейся verrecke"),
    (LEWD | BODY, [""], "oral сексом"),
    (SELF, [""], "yourself herself себя себе dich"),
]

#: Neutral words one or two letters away from a term.
_NEUTRAL = frozenset(
    """дебит дебита дебиту дебитом дебет дебета дебюта дебют дебитор мазь мази мазью ступица ступицы ступицу товар товара товары твердь тварный тварного
    идиома идиом идиомы idiom idioms idioma batch batches where price prices crash trick regard rate rates ratio city dump dumb-terminal moro
    гида гиды гид сводка скотч скотобойня родина средина привод приводы правка правки дура-люм урожай уроди урок город города народ природа дрянь-код подарок подарка
    плагин клеток суд суда сума сумма суммы суму сумку сук-цесс дуга дубль дуги дурация assess asset assets base bases mass pass class bass cents
    крысолов грязные крестин крестины кредит кредиты тариф твари-фы сволока соло мороз моро mormon macron boron micro idiot-proof banker tanker regards
    болты балван болван-ка подогрев поток потока падеж падежа гадание лист плохо плох слот скоты скота скоту скотом""".split()
)
#: Terms too close to common words to be sought with a fault.
_EXACT = frozenset("bitch bitches whore whores retard retards wanker wankers slut sluts twat cunt cunts hure huren penner tosser depp deppe лох скот упырь козел сук сука суки дура дуры чмо говно".split())

_LOOK_CYR = str.maketrans({"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "y": "у", "x": "х", "k": "к", "m": "м", "t": "т", "h": "н", "b": "в", "i": "и", "u": "и", "n": "п", "r": "г"})
_LOOK_LAT = str.maketrans({"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ӏ": "l", "и": "u", "г": "r", "п": "n", "ɡ": "g"})
_SIGNS_LAT = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "!": "i", "€": "e", "+": "t", "|": "l"})
_SIGNS_CYR = str.maketrans({"@": "а", "$": "с", "0": "о", "1": "и", "3": "е", "4": "ч", "6": "б", "9": "я", "!": "и", "8": "в", "5": "с", "7": "т"})

_INVISIBLE = re.compile(r"[­͏؜ᅟ᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n[\s/*>#|]*(?=[^\W\d_])")
_TAGS = re.compile(r"<[/!?]?[A-Za-z][^<>]*>|<!--|-->|&(?:nbsp|quot|amp|lt|gt|laquo|raquo|#\d+);")
_SPACED = re.compile(r"(?<![\w@$*])[\w@$*](?:(?P<gap>[ .\-_ ·]{1,2})[\w@$*])(?:(?P=gap)[\w@$*]){2,}(?![\w@$*])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"[\w@$*!+€]*[^\W_][\w@$*€]*|[«»\"“”„]|[.!?](?=\s|$)")
_MOJIBAKE = re.compile(r"[ÐÑÃ][\u0080-ÿŒ-Ÿ–-™ˆ˜]|â€")


def repaired(text: str) -> str:
    """Undoes UTF-8 that was read as a Western code page, where it can."""
    if len(_MOJIBAKE.findall(text)) < 3:
        return text
    raw = bytearray()
    for ch in text:
        if ord(ch) < 256:
            raw.append(ord(ch))
        else:
            try:
                raw += ch.encode("cp1252")
            except UnicodeEncodeError:
                raw += ch.encode()
    return raw.decode("utf-8", "replace")


class Levenshtein:
    """The automaton of all words within ``faults`` edits of a word, a swap of neighbours counting as one.

    It is compiled once for all words: a state is a set of (letters read, edits, in a swap) relative to a base, an
    input the vector of where a letter stands in the next letters of the word. ``table[state][vector]`` is the
    next state and how far the base moves on.
    """

    def __init__(self, faults: int):
        self.faults, self.width = faults, 2 * faults + 2
        start = frozenset({(0, 0, False)})
        self.states, self.table = [start], []
        known = {start: 0}
        for state in self.states:
            row = []
            for vector in range(1 << self.width):
                after, shift = self._step(state, vector)
                if after and after not in known:
                    known[after] = len(self.states)
                    self.states.append(after)
                row.append((known[after] if after else -1, shift))
            self.table.append(row)

    def _step(self, state: frozenset, vector: int) -> tuple[frozenset, int]:
        has = lambda i: vector >> i & 1
        found = set()
        for i, e, swap in state:
            if swap:
                if has(i):
                    found.add((i + 2, e, False))
                continue
            if has(i):
                found.add((i + 1, e, False))
            if e < self.faults:
                found |= {(i, e + 1, False), (i + 1, e + 1, False)}
                if has(i + 1):
                    found.add((i, e + 1, True))
                found |= {(i + k + 1, e + k, False) for k in range(1, self.faults - e + 1) if has(i + k)}
        kept = {(i, e, t) for i, e, t in found if t or not any(not u and f < e and abs(i - j) <= e - f for j, f, u in found)}
        shift = min((i for i, _, _ in kept), default=0)
        return frozenset((i - shift, e, t) for i, e, t in kept), shift

    def distance(self, state: int, rest: int) -> int:
        """Edits of a word that ends in ``state`` with ``rest`` letters after the base; more than ``faults`` if none will do."""
        return min((e + max(0, rest - i) for i, e, t in self.states[state] if not t and i <= rest), default=self.faults + 1)


class _Trie:
    """The lexicon: exact words, and those that are sought with spelling faults as a trie."""

    def __init__(self, faults: int = 1) -> None:
        self.root: dict = {}
        self.exact: dict[str, int] = {}
        self.longest = 0
        self.automaton = Levenshtein(faults)

    def add(self, word: str, roles: int, fuzzy: bool) -> None:
        self.exact[word] = self.exact.get(word, 0) | roles
        if fuzzy:
            self.longest = max(self.longest, len(word))
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = node.get("", 0) | roles

    def find(self, word: str) -> int:
        """Roles of the terms with the fewest faults; a ``*`` in the word stands for any letter."""
        auto = self.automaton
        if len(word) > self.longest + auto.faults:
            return 0
        masks: dict[str, int] = {}
        wild = 0
        for i, ch in enumerate(word):
            if ch == "*":
                wild |= 1 << i
            else:
                masks[ch] = masks.get(ch, 0) | 1 << i
        full, table, n = (1 << auto.width) - 1, auto.table, len(word)
        stack = [(self.root, 0, 0)]
        best, roles = auto.faults + 1, 0
        while stack:
            node, state, base = stack.pop()
            for ch, below in node.items():
                if ch == "":
                    d = auto.distance(state, n - base)
                    if d < best:
                        best, roles = d, below
                    elif d == best <= auto.faults:
                        roles |= below
                    continue
                after, shift = table[state][(masks.get(ch, 0) | wild) >> base & full]
                if after >= 0 and base + shift <= n:
                    stack.append((below, after, base + shift))
        return roles if best <= auto.faults else 0


#: Roles whose terms are sought with a spelling fault.
_FUZZY = SLUR | WEAK | GROUP | DEHUMAN | HARM | LEWD


def _lexicon() -> _Trie:
    trie = _Trie()
    for roles, endings, stems in _TERMS:
        for stem in stems.split():
            for ending in endings:
                word = (stem + ending).casefold().replace("ё", "е")
                if len(word) < 2 or word in _NEUTRAL:
                    continue
                trie.add(word, roles, bool(roles & _FUZZY) and len(word) >= 5 and word not in _EXACT)
    return trie


_LEXICON: list[_Trie] = []
_KNOWN: dict[str, tuple[int, str]] = {}
_NEAR: dict[str, int] = {}


def known_word(token: str) -> tuple[int, str]:
    """(roles, plain form) of a word as it stands in a text, disguised or misspelled though it may be."""
    known = _KNOWN.get(token)
    if known is None:
        if len(_KNOWN) > 300_000:
            _KNOWN.clear()
        known = _KNOWN[token] = _roles_of(token), _plain(token)
    return known


def _near(trie: _Trie, form: str) -> int:
    """Roles of the terms within the allowed faults of a form, marked as such."""
    found = _NEAR.get(form)
    if found is None:
        if len(_NEAR) > 300_000:
            _NEAR.clear()
        found = trie.find(form)
        found = _NEAR[form] = found | FAULT if found else 0
    return found


def _roles_of(token: str) -> int:
    if not _LEXICON:
        _LEXICON.append(_lexicon())
    trie = _LEXICON[0]
    word = token.casefold().replace("ё", "е").strip("_+!")
    if word in trie.exact:
        return trie.exact[word]
    if word in _NEUTRAL or len(word) < 3:
        return 0
    bare = re.sub(r"[\d_]+$", "", word) if not re.fullmatch(r"[^a-z]*[\d@$*!]+[a-z]{0,2}[\d@$*]+", word) else word
    forms = {bare, word.translate(_SIGNS_LAT).translate(_LOOK_LAT), word.translate(_SIGNS_CYR).translate(_LOOK_CYR)}
    pure = bare.isalpha() and (bare.isascii() or not re.search(r"[a-z]", bare))
    if pure:
        forms = {bare}
    found = 0
    for form in forms:
        if form in _NEUTRAL:
            continue
        for one in {form, _STRETCHED.sub(r"\1", form), re.sub(r"(.)\1+", r"\1", form) if _STRETCHED.search(form) else form}:
            if one in trie.exact and len(one) >= 3:
                found |= trie.exact[one]
        if not found and len(form) >= 5:
            found |= _near(trie, _STRETCHED.sub(r"\1", form))
        if not found and "*" in form and len(form) >= 4:
            hidden = re.compile(re.escape(form).replace(r"\*", ".")).fullmatch
            for term, roles in trie.exact.items():
                if len(term) == len(form) and hidden(term):
                    found |= roles
    return found


def _plain(token: str) -> str:
    """A word in its own script and lower case for the runs of words; names and numbers are all one sign."""
    word = _STRETCHED.sub(r"\1", _unmasked(token))
    return word if word.isalpha() and not re.search(r"[a-zа-я][A-ZА-Я]", token) else "#"


#: What a passage can show, with the given weights; the first is the bias.
PRIOR = {
    "bias": -3.0, "slur": 5.0, "aimed": 0.7, "fault": -2.5, "hatred": 4.5, "contempt": 3.3, "threat": 3.3, "wish": 1.0, "scorn": 1.0, "scorn_twice": 2.3,
    "explicit": 4.5, "lewd_twice": 3.3, "lewd": 0.5, "run": 0.45, "runs": 2.0,
}
NAMES = tuple(PRIOR)
_AT = {n: i for i, n in enumerate(NAMES)}
_KIND = {"slur": "insult", "scorn": "insult", "scorn_twice": "insult", "hatred": "hatred", "contempt": "hatred", "threat": "threat", "wish": "threat", "explicit": "sexual", "lewd_twice": "sexual", "lewd": "sexual"}


@dataclass
class Model:
    """Weights of the features and of the runs of words, these as nested dictionaries word by word."""

    weights: tuple[float, ...] = tuple(PRIOR.values())
    runs: dict = field(default_factory=dict)
    #: Words near a term that are words of their own.
    common: frozenset[str] = frozenset()


@dataclass
class Score:
    score: float = 0.0
    kind: str = ""
    quoted: bool = False


def _unmasked(token: str) -> str:
    """A word in its own script: signs and look-alikes become letters of the script most of it is in."""
    word = token.casefold().replace("ё", "е")
    if word.isalpha() and (word.isascii() or not re.search("[a-z]", word)):
        return word
    latin = len(re.findall("[a-z]", word))
    cyrillic = len(re.findall("[а-я]", word))
    return word.translate(_SIGNS_CYR).translate(_LOOK_CYR) if cyrillic >= latin and cyrillic else word.translate(_SIGNS_LAT).translate(_LOOK_LAT)


def _joined(m: re.Match) -> str:
    """Spaced letters as a word; a one-letter word may have stood before or after it."""
    word = m.group().replace(m.group("gap"), "")
    return f"{word} {word[1:]} {word[:-1]}" if len(word) > 4 else word


def _tokens(text: str) -> list[str]:
    plain = _INVISIBLE.sub("", repaired(text))
    if not plain.isascii():
        plain = unicodedata.normalize("NFC", plain)
    plain = _BROKEN.sub("", plain)
    if "<" in plain or "&" in plain:
        plain = _TAGS.sub(" ", plain)
    if _SPACED.search(plain):
        plain = _SPACED.sub(_joined, plain)
    return _TOKEN.findall(plain)


def _quotation(tokens: list[str]) -> list[bool]:
    """Whether each token stands within quotation marks; a straight mark opens and closes in turn."""
    out, opened = [], []
    for t in tokens:
        if t == '"':
            opened.pop() if opened and opened[-1] == '"' else opened.append('"')
        elif t in ("«", "„") or (t == "“" and "„" not in opened):
            opened.append(t)
        elif t in ("»", "”", "“") and opened:
            opened.pop()
        out.append(bool(opened))
    return out


_MARKS = frozenset('«»"“”„.!?')
_LEAD = SLUR | WEAK | HARM | LEWD | GROUP


def _run_weights(words: list[str], runs: dict) -> dict[int, float]:
    """The weight of the heaviest known run of words that begins at each place."""
    out: dict[int, float] = {}
    for i, w in enumerate(words):
        node = runs.get(w)
        j = i
        while node is not None:
            weight = node.get("")
            if weight is not None and weight > out.get(i, 0.0):
                out[i] = weight
            j += 1
            node = node.get(words[j]) if j < len(words) else None
    return out


def passages(tokens: list[str], model: Model) -> Iterator[tuple[int, list[float]]]:
    """(place, features) of each passage that holds a leading term or a suspect run of words."""
    pairs = [(0, "#") if t in _MARKS else known_word(t) for t in tokens]
    common = model.common
    roles = [0 if r & FAULT and w in common else r for r, w in pairs]
    heavy = _run_weights([w for _, w in pairs], model.runs) if model.runs else {}
    for i, r in enumerate(roles):
        if not (r & _LEAD or i in heavy):
            continue
        lo, hi = max(0, i - WINDOW), i + 1 + WINDOW
        around = roles[lo:i] + roles[i + 1 : hi]
        together = right = 0
        for x in around:
            together |= x
            if not x & FAULT:
                right |= x
        f = [0.0] * len(NAMES)
        f[0] = 1.0
        aimed = bool(together & PERSON)
        if r & SLUR:
            f[_AT["slur"]], f[_AT["aimed"]] = 1.0, float(aimed)
        fault = bool(r & FAULT)
        if r & GROUP and together & DEHUMAN:
            f[_AT["hatred"]] = 1.0
            fault |= not right & DEHUMAN
        elif r & GROUP and right & (WEAK | HARM):
            f[_AT["contempt"]] = 1.0
        if r & HARM:
            f[_AT["threat"]] = float(bool(right & (SLUR | GROUP | SELF)))
            f[_AT["wish"]] = float(aimed)
        if r & WEAK and aimed:
            f[_AT["scorn"]] = 1.0
            f[_AT["scorn_twice"]] = float(bool(right & WEAK))
        if r & LEWD:
            others = bool(right & LEWD)
            if aimed and (others or (right | r) & BODY):
                f[_AT["explicit"]] = 1.0
            elif others and right & BODY:
                f[_AT["lewd_twice"]] = 1.0
            f[_AT["lewd"]] = float(aimed)
        f[_AT["fault"]] = float(fault)
        if heavy:
            near = [heavy[j] for j in range(lo, hi) if j in heavy]
            if near:
                f[_AT["run"]], f[_AT["runs"]] = max(near), min(len(near), 6) / 6
        yield i, f


def best_passage(text: str | None, model: Model) -> tuple[float, int, list[float] | None, list[str]]:
    """(logit, place, features, tokens) of the highest-scoring passage; no features if none is suspect."""
    best: tuple[float, int, list[float] | None, list[str]] = (-30.0, -1, None, [])
    if not text:
        return best
    tokens = _tokens(text)
    weights = model.weights
    for i, f in passages(tokens, model):
        logit = sum(w * x for w, x in zip(weights, f))
        if logit > best[0]:
            best = logit, i, f, tokens
    return best


def score_text(text: str | None, model: Model = Model()) -> Score:  # noqa: B008
    """The highest-scoring passage of a text; null and empty texts score 0."""
    logit, at, f, tokens = best_passage(text, model)
    if f is None:
        return Score()
    shown = max(range(1, len(NAMES)), key=lambda k: model.weights[k] * f[k])
    return Score(float(1 / (1 + np.exp(-logit))), _KIND.get(NAMES[shown], "passage"), _quotation(tokens)[at])


def majority(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, y) of the documents that more raters call toxic than not, or the reverse; ties and null ratings tell nothing."""
    votes = labels.groupBy(key).agg(F.count_if(F.col(label) == 1).alias("yes"), F.count_if(F.col(label) == 0).alias("no"))
    return votes.where(F.col(key).isNotNull() & (F.col("yes") != F.col("no"))).select(key, (F.col("yes") > F.col("no")).alias("y"))


def fit(x: np.ndarray, y: np.ndarray, firmness: float = FIRMNESS) -> tuple[float, ...]:
    """Logistic weights by Newton's method, drawn to the given ones; the sign of a weight never turns."""
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + firmness * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + firmness * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in np.where(prior > 0, np.maximum(w, 0), np.minimum(w, 0)))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model fitted on the majority labels of at most LABELLED documents, chosen by the hash of their key.

    A word near a term that SUPPORT documents hold that are not toxic is a word of its own, no misspelled term. Runs
    of words are weighted by the log odds of the toxic documents without a passage the lexicon finds, of which
    SUPPORT must hold them, against the others. The weights of the features are fitted on each half of the
    documents with the runs of the other half, so they learn how far runs can be trusted; the model then has the
    runs of both halves. Only counts and feature rows of labelled documents, both bounded, reach the driver;
    without labels the given weights hold.
    """
    spark = documents.sparkSession
    # At most LABELLED rows are chosen and broadcast.
    chosen = majority(labels, key).orderBy(F.xxhash64(key), key).limit(LABELLED)
    half = F.pmod(F.xxhash64(key, F.lit("half")), F.lit(2)).cast("int")
    known = cut(documents.select(key, text).join(F.broadcast(chosen), key).select(F.col(text).alias("text"), "y", half.alias("half")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = Model()
        for b in batches:
            runs, yes, halves = [], [], []
            for t, y, h in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), b.column("half").to_pylist()):
                if y and best_passage(t, given)[0] >= 0:
                    continue  # the lexicon tells it already
                pairs = [(0, "#") if w in _MARKS else known_word(w) for w in _tokens(t or "")]
                words = [w for _, w in pairs]
                found = {" ".join(words[i : i + n]) for n in RUN_WORDS for i in range(len(words) - n + 1) if words[i] != "#" and words[i + n - 1] != "#"}
                found |= {w for r, w in pairs if r & FAULT} | {"#"}  # words near a term; one sign for each document
                runs += found
                yes += [y] * len(found)
                halves += [h] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(yes, pa.bool_()), pa.array(halves, pa.int32())], names=["run", "y", "half"])

    by = lambda y, h: F.count_if((F.col("y") == y) & (F.col("half") == h))
    counted = known.mapInArrow(spread, "run string, y boolean, half int").groupBy("run").agg(*[by(y, h).alias(f"{'yes' if y else 'no'}{h}") for y in (True, False) for h in (0, 1)])
    counted = cut(counted.where((F.col("yes0") + F.col("yes1") >= SUPPORT) | ~F.col("run").contains(" ")))
    near = counted.where(~F.col("run").contains(" ") & (F.col("no0") + F.col("no1") >= SUPPORT))
    common = {r["run"] for r in near.orderBy(F.desc(F.col("no0") + F.col("no1")), "run").limit(RUNS).collect()} - {"#"}
    size = next((r.asDict() for r in counted.where("run = '#'").collect()), {"yes0": 0, "yes1": 0, "no0": 0, "no1": 0})
    kept = counted.where(F.col("run").contains(" ")).orderBy(F.desc((F.col("yes0") + F.col("yes1") + 0.5) / (F.col("no0") + F.col("no1") + 0.5)), "run").limit(RUNS).collect()

    def weighted(halves: tuple[int, ...], support: int) -> dict:
        runs: dict = {}
        p, n = (sum(size[f"{y}{h}"] for h in halves) + 1.0 for y in ("yes", "no"))
        for r in kept:
            yes, no = sum(r[f"yes{h}"] for h in halves), sum(r[f"no{h}"] for h in halves)
            # The lower end of the log odds, so that few documents weigh little.
            odds = np.log((yes + 0.5) / p) - np.log((no + 0.5) / n) - SURE * np.sqrt(1 / (yes + 1) + 1 / (no + 1))
            if yes >= support and odds > 1:
                node = runs
                for word in r["run"].split(" "):
                    node = node.setdefault(word, {})
                node[""] = float(odds)
        return runs

    other = [Model(runs=weighted((1 - h,), max(1, SUPPORT - 1)), common=frozenset(common)) for h in (0, 1)]
    sent = spark.sparkContext.broadcast(other)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [best_passage(t, sent.value[h])[2] for t, h in zip(b.column("text").to_pylist(), b.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("y")], names=["f", "y"])

    fitted = known.mapInArrow(shown, "f array<double>, y boolean").where("f is not null").toArrow()
    model = Model(runs=weighted((0, 1), SUPPORT), common=frozenset(common))
    if fitted.num_rows:
        x = np.array(fitted.column("f").to_pylist())
        model.weights = fit(x, fitted.column("y").to_numpy(zero_copy_only=False).astype(float))
    return model


def normal_source(source: Column) -> Column:
    """Sources are the same up to letter case, blanks around them and ``-`` for ``_``; a missing one is ``unknown``."""
    bare = F.translate(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), "-", "_")
    return F.when(bare.isNull() | (bare == ""), F.lit("unknown")).otherwise(bare)


def abuse_scores(df: DataFrame, model: Model = Model(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:  # noqa: B008
    """(key, source, score, kind, quoted) of every document; null and empty texts score 0.

    No shuffle: texts are scored where they are read, whole. Extra columns are ignored; repeated rows are
    scored each. ``quoted`` tells whether the worst passage stands in quotation marks: it counts all the same.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [score_text(t, sent.value) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "score": [x.score for x in s], "kind": [x.kind for x in s], "quoted": [x.quoted for x in s]})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), normal_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, source string, score double, kind string, quoted boolean").withColumnRenamed("id", key)


def abuse_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, flagged, quoted, rate): the rate of such documents of every source."""
    hit = F.col("score") >= threshold
    counts = scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(hit).alias("flagged"), F.count_if(hit & F.col("quoted")).alias("quoted"))
    return counts.withColumn("rate", F.col("flagged") / F.col("documents"))


def agreement(scores: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(fitted, documents, toxic, flagged, both): how the scores meet the majority labels, apart for documents beyond the LABELLED ones."""
    voted = majority(labels, key)
    chosen = voted.orderBy(F.xxhash64(key), key).limit(LABELLED).select(key, F.lit(True).alias("fitted"))
    met = scores.join(voted, key).join(F.broadcast(chosen), key, "left")
    hit = F.col("score") >= threshold
    return met.groupBy(F.coalesce("fitted", F.lit(False)).alias("fitted")).agg(F.count(F.lit(1)).alias("documents"), F.count_if("y").alias("toxic"), F.count_if(hit).alias("flagged"), F.count_if(hit & F.col("y")).alias("both"))
