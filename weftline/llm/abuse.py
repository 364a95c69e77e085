"""Scores for abusive, hateful and sexual content, in any spelling.

A text is folded first: invisible characters and empty comments go, look-alike
letters and digits become the letters they stand for, spaced or dotted letters
become words. Words are then looked up in a trie of the lexicon by running a
Levenshtein automaton along it (one edit, a swap counting as one; none for short
words), and starred words by their visible letters. Context decides the rest:
patterns aim a term at somebody, and a term that is quoted, reported, studied or
condemned weighs less. Where readers have judged documents, further words and
the weights of their contexts are learned from them (``wording.py``); the
lexicon itself is general and holds no sentence of any corpus.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.stretches import spread, stretches
from weftline.llm.wording import NO_SPACES, Wording, fit_wording, read_words, windows
from weftline.plans.shared import Cut

# The lexicon. Insults and the adjectives that go with them, by language.
INSULTS = """
idiot idiots moron morons loser losers pig pigs bastard bastards scum ass asshole assholes dumbass dumbasses cretin cretins
imbecile imbeciles dimwit dimwits halfwit halfwits maggot maggots swine swines parasite parasites prick pricks dick dicks
vermin rat rats filth bitch bitches cunt cunts wanker wankers retard retards twat twats jerk jerks scumbag scumbags douchebag
arschloch idioten versager drecksau missgeburt ungeziefer wichser hurensohn schlampe abschaum fotze
imbécil gilipollas cabrón puta maricón idiota idiotas ratas basura
connard connards abruti abrutis salope ordure vermine enculé pute crétin
идиот идиоты урод уроды крысы сука мразь тварь ублюдок дебил
""".split()
ADJECTIVES = "filthy ugly rotten useless worthless miserable pathetic brainless braindead spineless stupid disgusting dumb fat dirty dummes dummer sale gros тупой тупая тупые".split()

# Further terms by category and language. "strong" ones name a person or group in no other way; "weak" ones have harmless uses.
TERMS = {
    ("insult", "strong"): {
        "en": "idiot idiots moron morons imbecile imbeciles cretin dimwit halfwit dumbass asshole assholes arsehole dickhead shithead fuckface fucktard motherfucker motherfuckers wanker wankers retard retards scumbag douchebag twat jackass dipshit dumbfuck bastard bastards bitch bitches",
        "de": "idiot idioten vollidiot vollidioten arschloch arschlöcher wichser hurensohn missgeburt drecksau vollpfosten schwachkopf dummkopf trottel spast drecksack",
        "es": "idiota idiotas imbécil imbéciles gilipollas cabrón cabrones estúpido estúpida pendejo pendejos subnormal maricón",
        "fr": "connard connards connasse abruti abrutis crétin crétins imbécile imbéciles enculé enculés débile salaud salauds",
        "ru": "идиот идиоты дебил дебилы урод уроды ублюдок ублюдки мразь тварь придурок кретин мудак дурак дура сволочь гнида",
        "ar": "غبي غبية أغبياء أحمق حمقى حقير حقراء وسخ قذر سافل نذل معتوه",
    },
    ("insult", "weak"): {
        "en": "loser losers pig pigs ass scum swine rat rats parasite maggot prick dick jerk filth trash garbage stupid dumb ugly pathetic shit crap freak clown worm animal",
        "de": "schwein schweine sau versager ratte ungeziefer abschaum dreck esel",
        "es": "basura rata ratas escoria cerdo burro",
        "fr": "ordure ordures porc vermine rat parasite bouffon",
        "ru": "свинья крыса крысы собака козел козёл баран",
        "ar": "كلب كلاب حمار حمير خنزير خنازير حيوان زبالة حثالة",
    },
    ("sexual", "strong"): {
        "en": "slut sluts whore whores hooker cumslut slag",
        "de": "schlampe schlampen hure huren nutte fotze",
        "es": "puta putas zorra zorras ramera",
        "fr": "salope salopes pute putes putain pétasse",
        "ru": "шлюха шлюхи сука суки блядь проститутка",
        "ar": "عاهرة شرموطة قحبة",
    },
    ("sexual", "weak"): {
        "en": "cock cocks dick tit tits boobs breast breasts pussy cunt penis balls clit ass naked nude nudes sex horny cum",
        "de": "schwanz titten muschi fotze arsch",
        "es": "polla coño verga tetas culo",
        "fr": "bite chatte nichons cul",
        "ru": "член хуй пизда сиськи жопа",
        "ar": "زبي كسك طيزك",
    },
    ("hate", "weak"): {
        "en": "vermin subhuman subhumans cockroaches filth scum parasites rats animals savages",
        "de": "ungeziefer abschaum untermenschen parasiten ratten gesindel",
        "es": "ratas escoria basura cucarachas parásitos",
        "fr": "vermine racaille parasites cafards rats",
        "ru": "крысы мразь нелюди паразиты отбросы",
        "ar": "حثالة جرذان حشرات كلاب",
    },
    ("profanity", "weak"): {"en": "fuck fucking shit crap bullshit", "de": "scheiße scheiss", "es": "mierda joder", "fr": "merde putain", "ru": "хуй блядь", "ar": "خرا"},
    ("threat", "weak"): {
        "en": "kill murder die burn stab strangle rape shoot behead slaughter hang bleed rot smash choke drown",
        "de": "umbringen töten töte sterben verrecken verrecke abstechen",
        "es": "matar mataré mataremos quemar muérete morir",
        "fr": "tuer tuerai crever crève égorger buter",
        "ru": "убью убьем зарежу сдохни сдохните сожгу",
        "ar": "سأقتلك سنقتلكم اقتلك أقتلك سأذبحك",
    },
}
# Words that speak to somebody directly, by language, and those that may stand between them and a term.
SPEAKING_TO = {"en": "you u ya yall", "de": "du ihr", "es": "eres sois tú vosotros", "fr": "tu vous espèce", "ru": "ты вы", "ar": "أنت انت أنتم انتم يا"}
BETWEEN = {
    "en": "are re r a an the such little fucking damn complete total absolute bloody goddamn bunch of all just nothing but lying old dirty",
    "de": "bist seid ein eine einen so alle nur kleiner kleine blöde blöder dreckige dreckiger verdammte verdammter",
    "es": "un una unos unas maldito maldita pedazo de muy", "fr": "es êtes un une de d des sale gros grosse petit petite vraiment", "ru": "просто настоящий тупой тупая жалкий", "ar": "يا مجرد",
}
IS = {"en": "is are", "de": "ist sind", "es": "es son", "fr": "est sont", "ru": "это", "ar": "هو هي هم"}
# Words for groups of people, as they are demeaned.
GROUPS = "people folk folks immigrants migrants foreigners refugees women gays lesbians jews muslims christians blacks whites arabs asians gypsies frauen ausländer juden mujeres inmigrantes judíos femmes immigrés juifs евреи мигранты женщины"
# Patterns of read words, by category and language; {prof}, {sex} and {kill} are the terms of those categories.
PATTERNS = {
    ("insult", "profanity"): [
        r"(?:you|u) (?:(?:are|re|fucking|little|stupid) )*(?:piece|pile|sack|load) of (?:\w+ )?(?:{prof}|garbage|trash)", r"fuck (?:you|u|yourself|yourselves|off|your|them all)", r"eat shit", r"(?:smells?|stinks?|looks?) (?:like|of) (?:{prof})", r"shut the fuck up", r"son of a bitch", r"go to hell (?:you|u)", r"full of (?:shit|crap) you", r"you are full of (?:shit|crap)",
        r"(?:fick|fickt) (?:dich|euch|deine)", r"leck mich am arsch", r"halt (?:dein|deine|die) (?:maul|fresse)", r"hij[oa]s? de (?:la )?(?:gran )?puta", r"(?:vete|iros|idos|váyanse) a la mierda", r"(?:me cago en|que te jodan|jódete|que te den)", r"de mierda eres",
        r"(?:va|allez) (?:te|vous) faire (?:foutre|enculer|voir)", r"nique (?:ta|ton|sa) \w+", r"fils de (?:pute|chien)", r"ta gueule", r"иди(?:те)? (?:на хуй|нахуй|в жопу|к черту)", r"пош[её]?л[аи]? (?:ты|вы)? ?(?:на хуй|нахуй|в жопу)", r"заткни(?:сь|тесь)", r"твою мать",
        r"كس (?:أمك|امك|أختك|اختك)", r"(?:ابن|بنت|أولاد|اولاد) (?:ال)?(?:كلب|حرام|شرموطة|قحبة|عاهرة)", r"(?:اخرس|إخرس) يا", r"(?:تبا|تفو) (?:لك|عليك|لكم)",
    ],
    ("threat", "threat"): [
        r"(?:i|we) (?:(?:am|are|m|re|will|ll|gonna|going|to|want|wanna|shall|would|love|gladly|come|and|personally) )+(?:{kill}) (?:(?:all|both|of) )*(?:you|your|u)", r"(?:i|we) (?:will|ll|am going to|m going to|are going to|gonna) (?:kill|murder|rape|behead|stab) (?:him|her|them)",
        r"(?:hope|wish|pray) (?:that )?(?:you|u|they|he|she) (?:all |just |both )?(?:{kill}|suffer|get (?:shot|cancer|killed))", r"(?:you|u) (?:all )?(?:should|must|deserve to|ought to|need to) (?:all |just |be )?(?:{kill}|beaten|shot|hanged|killed)", r"(?:kill|hang|drown|shoot|stab) (?:yourself|yourselves)", r"(?:go|just) (?:and )?die(?: in| you|$)", r"(?:burn|rot) in hell", r"\bkys\b",
        r"(?:exterminate|eradicate|gas|deport|wipe out|get rid of) (?:them|you|these|those) (?:all|people|vermin)", r"(?:hope|wish) your (?:\w+ ){0,2}(?:burns?|dies?|rots?|crashes|suffers?)",
        r"deserves? to (?:die|be (?:killed|shot|hanged|burned|raped))", r"smash your (?:skull|face|head|teeth)", r"slit your throat", r"(?:we|i) know where you (?:live|sleep)",
        r"ich (?:bring|bringe|stech|steche|mach|mache) (?:dich|euch) (?:um|ab|kalt|fertig)", r"(?:töte|erschieße|erwürge) (?:ich )?(?:dich|euch)", r"du (?:sollst|wirst) (?:sterben|brennen|verrecken|bluten)", r"\bverrecke?\b",
        r"(?:te|os) (?:voy|vamos) a (?:matar|quemar|romper|violar|degollar)", r"(?:te|os) (?:mataré|mataremos)", r"\bmu[ée]rete\b", r"(?:je|on) (?:vais|va) (?:te|vous) (?:tuer|buter|crever|égorger|violer)", r"je (?:te|vous) tuerai", r"\bcrève\b",
        r"(?:тебя|вас) (?:убью|убь[её]м|зарежу|сожгу)", r"(?:убью|убь[её]м|зарежу|сожгу) (?:тебя|вас)", r"\bсдохни(?:те)?\b", r"чтоб (?:ты|вы) сдох(?:ли)?", r"\b(?:سأقتلك|سأقتلكم|سنقتلك|سنقتلكم|سأذبحك)\b",
    ],
    ("sexual", "sexual"): [
        r"(?:suck|sucks|sucking|lick|ride|taste|fuck|show me|see|touch|squeeze|feel) (?:on )?(?:my|your|his|her|the) (?:(?:\w+ )?(?:cock|dick|tits|boobs|pussy|cunt|clit|balls|nudes)|(?:huge|wet|naked|bare|big) (?:{sex}))", r"sucks? (?:cocks?|dicks?)", r"your (?:wet|naked|tight|huge|big|hot|horny) (?:{sex})", r"(?:i|we) (?:want|wanna|will|ll|would love|am going|m going) (?:to )?(?:fuck|bang|rape|screw) (?:you|your|her|him)",
        r"(?:suck|sucks|sucked|sucking|jerk|jerked|wank|wanked) (?:him|her|me|them|you) off", r"want sex with (?:you|me)", r"you (?:\w+ )?horny", r"(?:lutsch|leck|blas) (?:mir|mich|meinen|meine)", r"deine (?:\w+ )?(?:titten|fotze|muschi)", r"(?:chúpame|chupame|mámame|mamame) (?:la|el)", r"(?:mi|tu) (?:\w+ )?(?:polla|coño|verga|tetas)", r"suce (?:moi|ma|mon)", r"(?:ma|ta) (?:grosse |petite )?(?:bite|chatte)", r"\b(?:отсоси|соси) (?:мой|мне|хуй|член)", r"(?:трахну|трахать) (?:тебя|её|вас)",
    ],
}
# Words of a context that reports or studies, beside REPORTED, for the patterns.
STUDIED = set("""
if when unless said wrote novel film song album poem chapter published titled translated word words insult insults insulted insulting vulgar slang etymology linguists dictionary considered quoted quote quotes game player actor character farmers rodent medical
wort wörter schimpfwort roman palabra término novela mot terme vulgaire étudié linguistes слово слова термин роман كلمة رواية
""".split())
# Whole strings for scripts without spaces, by category.
STRINGS = {"insult": ["死ね", "氏ね", "タヒね", "馬鹿野郎", "莫迦野郎", "バカ野郎", "クズ野郎", "クソ野郎", "くたばれ", "消え失せろ"], "threat": ["殺すぞ", "殺してやる", "ぶっ殺"], "sexual": ["ヤリマン", "売女め"]}
#: Strings that count in a stretch that also speaks to somebody.
AIMED_STRINGS = re.compile("お前|おまえ|てめえ|てめぇ|貴様|きさま|あんた")
WEAK_STRINGS = re.compile("馬鹿|バカ|ばか|アホ|阿呆|クズ|ゴミ|カス|ブス|デブ|間抜け|低能|豚")
_STUDIED_STRINGS = re.compile("という言葉|という語|用語|研究|語源|意味する|と述べ|と報じ|と呼ばれ")
# Words that aim a term at somebody, and words of a context that reports, studies or condemns it.
AIMED = "you your yourself u du dich ihr seid eres te tu ta".split()
REPORTED = """
reported called calling review withdrew apologised apologized condemned fined sued convicted describing described study studied slur slurs lists entries collected legal term word recorded court courts claim
explains education species reproduction rated discussed history posters
""".split()
# Letters that look like Latin ones, and signs that stand for letters.
#: Words too common to count in a phrase.
COMMON = set("the of was in and is to a be are that from all do with will has by so it her as out for".split())
#: Everyday words one edit away from a word of the lexicon; they are not misspellings of it.
ORDINARY = set("""
with work that than what down brown town form word worn world warm slopes slope stub star scar mock bock seit tras hurt hurl hope wide ways wash dish list lost lose choose chose poke broke spoke smash mash stash strange orange
cold gold bold told walk talk both book look took hook time dime rude node note mode made side site size kite quote route mouse house hose rose nose post cost most host role hole sole pole bath path math
duck luck buck tuck puck muck funk pluck ducks lucky shirt shift short shut ship shot sit suit spit skit slit slot glut shin hit kiln bill hill will till fill pill mill still skill skills kiss kilt kin
horn thorny corny driver drives drive pale tale male same scale sales safe sake salt dock rock lock sock cook click clock cork cocky dice nick pick sick deck duke disk dish kick lick tick wick
batch pitch ditch witch beach hatch count cent hunt punt cult cut runt can aunt price brick trick prince pricks swing shine spine twine swift scam score sum slum swam dumb moron maroon idiom idiots
loner lover loses lower loose poser closer pug peg pin pit pie big dig fig wig rig mat cat bat rate rates rays rant raft rafts cats bats mats hats verb vermont permit fifth faith filch width
crab crop clap trap wrap cramp scrap craft bits hits kits sits ties tin tip breasts bread beast breath breasted nasty bastion custard mustard dastard puma pura pita puta ruta pasta
conard canard renard étalon crevez creser gras gris grois seller jerky clerk perk jest maggots dies dive dine dim dip dye lie burns born barn turn bun bird bury burnt
""".split())
LOOKALIKES = str.maketrans("аеорсухіјѕкмтвнԁһԛԝѵгαοερτνικυχ", "aeopcyxijskmtbhdhqwvraoeptvikux")
SIGNS = str.maketrans("0134578@$!", "oieastbasi")

#: Characters of stretches of text that a worker remembers before it forgets them all.
REMEMBERED_CHARACTERS = 8_000_000
#: A document is listed from this score on.
FLAG_FROM = 1.0
#: Condemned and clean documents that a model is learned from, at most.
MAX_CONDEMNED, MAX_CLEAN = 3_000, 10_000
#: Log-odds of a learned wording that count as FLAG_FROM.
LEARNED_FROM = -3.0

_EMPTY_COMMENT = re.compile(r"<!--[\s\-]*-->")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_])[^\W_@$!])(?:\1[^\W_]|\1[@$!])+(?![^\W_])")
_TOKEN = re.compile(r"[\w@$!*]+|[=\"“”„«»]|''+|[.?;\n|\[\]{}<>]")
_BREAK = set(".?;\n|[]{}<>")
_ENDS = set(".?;\n")
_QUOTE = {'"', "“", "”", "„", "«", "»", "''"}
_RUN = regex.compile(r"(\p{L})\1{2,}")
_LATIN = regex.compile(r"[a-z]")
_LOOK = regex.compile("[аеорсухіјѕкмтвнԁһԛԝѵгαοερτνικυχ]")


def fold(text: str) -> str:
    """Lower case without invisible characters, empty comments, compatibility forms and spaced-out words."""
    if "<!--" in text:
        text = _EMPTY_COMMENT.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Mn") or c == "\n") if any(unicodedata.category(c) in ("Cf", "Mn") for c in set(text)) else text
        text = unicodedata.normalize("NFC", text)
    text = text.lower()
    return _SPACED.sub(lambda m: m.group().replace(m.group(1), ""), text)


#: The strings, folded as the texts are, with blanks and marks that may part their characters.
_STRING_PATTERNS = {kind: re.compile("|".join(r"[ \u3000・.\-_*~〜ー]{0,2}".join(map(re.escape, fold(s))) for s in strings)) for kind, strings in STRINGS.items()}


def tokens_of(folded: str) -> list[str]:
    """Words, quotes and breaks of a folded text; an underscore parts words as a blank does."""
    return _TOKEN.findall(folded.replace("_", " "))


def spell_out(token: str) -> str:
    """A token with signs, digits, look-alikes and drawn-out letters read as letters."""
    token = token.rstrip("!")
    if token == "@":
        return "a"
    if not token.isalpha() and not token.isdigit() and "*" not in token and any(c in "@$!" or c.isdigit() for c in token):
        letters = sum(c.isalpha() for c in token)
        if letters or any(c in "@$!" for c in token):
            token = token.translate(SIGNS)
    if _LOOK.search(token) and (_LATIN.search(token) or len(token) == 1):
        token = token.translate(LOOKALIKES)
    return _RUN.sub(r"\1", token)


def _cut_short(word: str) -> list[str]:
    """The word, and the word without each of its letters."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class LexiconTrie:
    """Words in a trie, met by a Levenshtein automaton of a token."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        self.exact = {w: i for i, w in enumerate(self.words)}
        self.root: dict = {}
        for i, w in enumerate(self.words):
            at = self.root
            for c in w:
                at = at.setdefault(c, {})
            at[""] = i
        # a word and a token one edit apart (a swap too) are equal, or share what is left when a letter is taken out of one or both
        self._cut = {x for w in self.words for x in _cut_short(w)}

    def near(self, token: str, most: int) -> list[int]:
        """Words within ``most`` edits (insert, delete, replace, swap of neighbours): the automaton's states are the edits so far by position, kept while one is alive."""
        if most == 1 and self._cut.isdisjoint(_cut_short(token)):
            return []
        n, found = len(token), []
        stack = [(self.root, "", {i: i for i in range(min(most, n) + 1)}, {}, "")]
        while stack:
            node, char, states, earlier, before = stack.pop()
            if "" in node and states.get(n, most + 1) <= most:
                found.append(node[""])
            for c, child in node.items():
                if not c:
                    continue
                after: dict[int, int] = {}
                for i, e in states.items():
                    if i < n and token[i] == c and e < after.get(i + 1, 9):
                        after[i + 1] = e
                    if e < most:
                        if e + 1 < after.get(i, 9):
                            after[i] = e + 1
                        if i < n and e + 1 < after.get(i + 1, 9):
                            after[i + 1] = e + 1
                for i, e in earlier.items():
                    if e < most and i + 2 <= n and token[i] == c and token[i + 1] == char and e + 1 < after.get(i + 2, 9):
                        after[i + 2] = e + 1
                for i in sorted(after):
                    if i < n and after[i] < most and after[i] + 1 < after.get(i + 1, 9):
                        after[i + 1] = after[i] + 1
                if after:
                    stack.append((child, c, after, states, char))
        return found


def categories_of(extra_terms: list[tuple[str, str]] = ()) -> dict[str, tuple[str, ...]]:
    """Categories of the lexicon's words, as ``#category``; ``#to`` for words that speak to somebody, ``#report`` for those that report or study."""
    out: dict[str, set[str]] = defaultdict(set)
    for (kind, _), by_lang in TERMS.items():
        for words in by_lang.values():
            for w in words.split():
                out[fold(w)].add(f"#{kind}")
    for w in INSULTS:
        out[fold(w)].add("#insult")
    for words in SPEAKING_TO.values():
        for w in words.split():
            out[fold(w)].add("#to")
    for w in (*REPORTED, *STUDIED):
        out[fold(w)].add("#report")
    for term, kind in extra_terms:
        if kind and kind != "none" and len(words := tokens_of(fold(term))) == 1:
            out[words[0]].add(f"#{kind.lower()}")
    return {w: tuple(sorted(kinds)) for w, kinds in out.items()}


def near_words(words: set[str]):
    """A function that finds the word of ``words`` that a word of four letters or more is one edit away from, the least of several; else None."""
    trie = LexiconTrie([w for w in words if len(w) > 3])
    memo: dict[str, str | None] = {}

    def near(word: str) -> str | None:
        if len(word) < 4 or not word.isalpha() or word in trie.exact:
            return None
        if word not in memo:
            if len(memo) > 400_000:
                memo.clear()
            memo[word] = min((trie.words[i] for i in trie.near(word, 1) if len(word) > 4 or len(trie.words[i]) == 4), default=None)
        return memo[word]

    return near


def clauses(text: str | None) -> set[tuple[str, ...]]:
    """The sentences and lines of a text, as read words."""
    out: set[tuple[str, ...]] = set()
    for part in set(stretches(text, after_exclamation=False)):
        tokens = tokens_of(fold(part))
        for start, end in _spans(tokens):
            out.update(w for w in windows(read_words(map(spell_out, tokens[start:end]))) if w)
    return out


def _spans(tokens: list[str]) -> Iterator[tuple[int, int]]:
    """First place and the place behind the last of each clause."""
    start = 0
    for end in [*(x for x, t in enumerate(tokens) if t in _ENDS), len(tokens)]:
        if end > start:
            yield start, end
        start = end + 1


class Scorer:
    """Scores texts; keeps what it found out about tokens it met."""

    def __init__(self, extra_terms: list[tuple[str, str]] = (), wording: Wording | None = None):
        self.wording = wording or Wording()
        self.categories = categories_of(extra_terms)
        self.insults = set(INSULTS) | {fold(t) for t, kind in extra_terms if kind in ("insult", "hate") and len(t) > 3 and len(t.split()) == 1}
        self._compile(extra_terms)
        learned = self.wording.words()
        every = set().union(self.insults, ADJECTIVES, AIMED, REPORTED, self.anchors, self.categories, learned)
        self.trie = LexiconTrie([fold(w) for w in every])
        index = lambda words: {self.trie.exact[fold(w)] for w in words}
        self.is_anchor = index(self.anchors)
        self.is_insult, self.is_adjective, self.is_aimed, self.is_reported = index(self.insults), index(ADJECTIVES), index(AIMED), index(REPORTED)
        anchors = self.wording.anchors
        self.is_cue = index(w for w in anchors if not w.startswith("#")) | {self.trie.exact[w] for w, kinds in self.categories.items() if not anchors.isdisjoint(kinds)}
        self.cue_letters = {w for w in anchors if len(w) == 1 and NO_SPACES.search(w)}
        self.reported = {fold(w) for w in REPORTED}
        self.ordinary = ORDINARY.union(self.wording.ordinary).difference(self.trie.exact)
        #: English "die" is also the commonest German word; one of these stands beside every threat with it.
        self.with_die = {*SPEAKING_TO["en"].split(), "they", "he", "she", "all", "go", "just", "deserve", "deserves"}
        self.firsts = {w[:-1]: w for w in self.trie.words if len(w) > 4}
        self.lasts = {w[1:]: w for w in self.trie.words if len(w) > 4}
        self.known: dict[str, tuple[tuple[tuple[int, bool], ...], bool]] = {}
        self._parts: dict[str, list[tuple[str, float]]] = {}
        self._held = 0

    def _compile(self, extra_terms: list[tuple[str, str]]) -> None:
        """The patterns of all terms, and the words without which none of them can match; terms of the table join those of every language."""
        extra: dict[str, set[str]] = defaultdict(set)
        for term, kind in extra_terms:
            extra[kind.lower()].add(" ".join(tokens_of(fold(term))))
        sets = {(kind, strength, lang): {fold(w) for w in words.split()} for (kind, strength), by_lang in TERMS.items() for lang, words in by_lang.items()}
        by_kind = {kind: set().union(*(words for (k, _, _), words in sets.items() if k == kind), extra[kind]) for kind in ("profanity", "threat", "sexual")}
        either = lambda words: "|".join(sorted((re.escape(w) for w in words if w), key=lambda w: (-len(w), w))) or "(?!)"
        slots = {"{prof}": either(by_kind["profanity"]), "{kill}": either(by_kind["threat"]), "{sex}": either(by_kind["sexual"])}
        self.patterns: list[tuple[str, float, re.Pattern]] = []
        self.anchors: set[str] = set().union(*sets.values())
        for words in extra.values():
            self.anchors |= {max(w.split(), key=len) for w in words if w}
        self.anchors -= COMMON
        adjectives = {fold(w) for w in ADJECTIVES}
        mild = set().union(*(words for (kind, strength, _), words in sets.items() if (kind, strength) == ("sexual", "weak")))
        for lang, speaking in SPEAKING_TO.items():
            pick = lambda kind, strength: sets.get((kind, strength, lang), set())  # noqa: B023, E731
            strong = pick("insult", "strong") | pick("sexual", "strong")
            to, between, is_ = ("|".join(words.split()) for words in (speaking, BETWEEN[lang], IS[lang]))
            between = f"{between}|{either(adjectives)}"
            for kind, words in (("insult", strong | pick("insult", "weak") | extra["insult"] | extra["hate"]), ("sexual", pick("sexual", "strong") | (extra["sexual"] - mild))):
                self.patterns.append((kind, 1.3, re.compile(rf"\b(?:{to}) (?:(?:{between}) ){{0,4}}(?:{either(words)})\b")))
            self.patterns.append(("insult", 1.1, re.compile(rf"\b(?:{is_}) (?:(?:{between}) ){{0,4}}(?:{either(strong)})\b")))
            self.patterns.append(("insult", 1.2, re.compile(rf"\b(?:{either(adjectives)}) (?:{either(strong)})\b")))
            groups = pick("hate", "weak") | (extra["hate"] if lang == "en" else set())
            self.patterns.append(("hate", 1.3, re.compile(rf"\b(?:these|those|all|diese|alle|esos|estos|todos|ces|tous|эти|все|هؤلاء) (?:\w+ )?(?:(?:{is_}) )(?:(?:{between}) ){{0,2}}(?:{either(groups)})\b")))
            self.patterns.append(("hate", 1.3, re.compile(rf"\b(?:{'|'.join(GROUPS.split())}) (?:{is_}) (?:(?:{between}) ){{0,2}}(?:{either(groups)})\b")))
        for (kind, _), lines in PATTERNS.items():
            for line in lines:
                for slot, words in slots.items():
                    line = line.replace(slot, words)
                self.patterns.append((kind, 1.3, re.compile(rf"(?<!\w)(?:{line})(?!\w)")))
        # every word of the fixed patterns that is no function word can call for them
        self.anchors |= {fold(w) for w in "fuck bitch hell arsch maul fresse jódete jodan faire foutre enculer nique pute gueule нахуй заткнись заткнитесь мать скот كس اخرس ابن تبا kys yourself yourselves throat skull murder suck sucks lick horny bring umbringen stech crève muérete сдохни трахну соси отсоси chúpame chupame mámame lutsch suce bite hope wish deserve deserves fick fickt leck exterminate eradicate deport burns wank wanked sucked jerked".split()}

    def _score_clauses(self, tokens: list[str], hits: list[tuple[int, tuple[tuple[int, bool], ...]]], best: dict[str, float]) -> None:
        """Terms of all categories in the wording around them, clause by clause: patterns less quotes, reports and studies, and the learned weights of the context."""
        ordinary = self.ordinary
        places = [(at, ids) for at, ids in hits if tokens[at] not in ordinary]
        read = {at for at, ids in places if any(i in self.is_anchor for i, _ in ids) and (tokens[at] != "die" or not self.with_die.isdisjoint(tokens))}
        cued = {at for at, ids in places if any(i in self.is_cue for i, _ in ids)}
        if self.cue_letters:
            cued |= {at for at, t in enumerate(tokens) if not t.isascii() and not self.cue_letters.isdisjoint(t)}
        if not read and not cued:
            return
        words = list(map(spell_out, tokens))
        for at, ids in places:
            sure = [i for i, s in ids if s] or [i for i, _ in ids if i in self.is_anchor or i in self.is_cue]
            if sure:
                words[at] = min((self.trie.words[i] for i in sure), key=lambda w: (w not in self.categories, w))
        for start, end in _spans(tokens):
            if any(start <= at < end for at in read):
                line = " ".join(w for w in words[start:end] if w != "=")
                for kind, base, pattern in self.patterns:
                    if base <= best.get(kind, 0.0):
                        continue
                    m = pattern.search(line)
                    if m:
                        first, last = start + line.count(" ", 0, m.start()), start + line.count(" ", 0, m.end())
                        near = range(max(start, first - 14), min(end, last + 15))
                        score = base - 0.6 * any(tokens[x] in _QUOTE for x in range(max(start, first - 5), min(end, last + 6)))
                        score -= 0.3 * min(3, sum(1 for x in near if words[x] in STUDIED or words[x] in self.reported))
                        if score > 0:
                            best[kind] = max(best[kind], score)
            if any(start <= at < end for at in cued):
                for part in windows(read_words(words[start:end])):
                    odds = self.wording.log_odds(part, self.categories)
                    # words that together speak against abuse list nothing, however high the model sets off
                    least = max(LEARNED_FROM, self.wording.bias)
                    if odds > least - 3:
                        kinds = [k[1:] for w in part for k in self.categories.get(w, ()) if k not in ("#to", "#report")]
                        kind = max(kinds, key=lambda k: (kinds.count(k), k), default="other")
                        best[kind] = max(best[kind], min(2.0, FLAG_FROM + (odds - least) / 4))

    def look_up(self, token: str) -> tuple[tuple[tuple[int, bool], ...], bool]:
        """The lexicon words a token may stand for, each with whether it does so to the letter; and whether a letter may have slipped into or out of it."""
        hit = self.known.get(token)
        if hit is None:
            if len(self.known) > 400_000:
                self.known.clear()
            exact = self.trie.exact
            slipped = token not in exact and token.isalpha() and (token in self.firsts or token in self.lasts or token[:-1] in exact or token[1:] in exact)
            near = () if token in _BREAK or token in _QUOTE else self._look_up(token)
            hit = self.known[token] = (near, slipped)
        return hit

    def _look_up(self, token: str) -> tuple[tuple[int, bool], ...]:
        word = spell_out(token)
        if "*" in word:
            bare, front, back = spell_out(word.strip("*")), len(word) - len(word.lstrip("*")), len(word) - len(word.rstrip("*"))
            if bare in self.trie.exact and (len(bare) > 3 or back < 2 or front == back):
                word = bare
        if word in self.trie.exact:
            return ((self.trie.exact[word], True),)
        if "*" in word:
            # stars at the ends may be marks of a list or of emphasis
            for shown in (word, word.strip("*")):
                seen = sum(c != "*" for c in shown)
                if "*" in shown and len(shown) >= 3 and (seen > 1 or seen and shown.count("*") > 1):
                    shape = regex.compile("".join("." if c == "*" else regex.escape(c) for c in shown))
                    found = tuple((i, False) for w, i in self.trie.exact.items() if len(w) == len(shown) and shape.fullmatch(w))
                    if found:
                        return found
            return ()
        if len(word) < 4 or not any(c.isalpha() for c in word):
            return ()
        least = len(word) if len(word) < 5 else 0
        return tuple((i, False) for i in self.trie.near(word, 1) if len(self.trie.words[i]) >= least)

    def _put_back(self, tokens: list[str], at: int) -> None:
        """Puts a letter that slipped over the blank after token ``at`` back, where that gives a word of the lexicon; a word of the lexicon or an ordinary one lost none."""
        a, b, exact = tokens[at], tokens[at + 1], self.trie.exact
        odd_a, odd_b = (w not in exact and w not in self.ordinary for w in (a, b))
        if not (a.isalpha() and b.isalpha() and (odd_a or odd_b)):
            return
        for x, y in ((a[:-1], a[-1] + b), (a + b[0], b[1:])):
            if (x in exact and y in exact) or (len(x) > 3 and x in exact and odd_a) or (len(y) > 3 and y in exact and odd_b):
                tokens[at], tokens[at + 1] = x, y
                return

    def score(self, text: str | None) -> tuple[float, str]:
        """(score, category of the strongest part), 0 and '' for null, empty and clean texts."""
        if not text:
            return 0.0, ""
        if self._held > REMEMBERED_CHARACTERS:
            self._parts.clear()
            self._held = 0
        best: dict[str, float] = defaultdict(float)
        for part in stretches(text, after_exclamation=False):
            found = self._parts.get(part)
            if found is None:
                found = self._parts[part] = self._read(part)
                self._held += len(part)
            for kind, score in found:
                best[kind] = max(best[kind], score)
        if not best:
            return 0.0, ""
        kind = max(best, key=lambda k: (best[k], k))
        return round(best[kind], 3), kind

    def _read(self, part: str) -> list[tuple[str, float]]:
        """The scores, by category, of the terms, wordings and strings in a stretch of text."""
        folded = fold(part)
        tokens = tokens_of(folded)
        known = self.known
        records = [known.get(t) or self.look_up(t) for t in tokens]
        for i in [i for i, r in enumerate(records) if r[1]]:
            for at in (i - 1, i):
                if 0 <= at < len(tokens) - 1:
                    self._put_back(tokens, at)
                    records[at : at + 2] = [self.look_up(tokens[at]), self.look_up(tokens[at + 1])]
        hits = [(i, r[0]) for i, r in enumerate(records) if r[0]]
        best: dict[str, float] = defaultdict(float)
        self._score_terms(tokens, hits, best)
        self._score_clauses(tokens, hits, best)
        self._score_strings(folded, best)
        return list(best.items())

    def _score_strings(self, folded: str, best: dict[str, float]) -> None:
        """Strings of scripts without spaces in a folded text, marks between their characters allowed, less a context that studies or reports them."""
        if folded.isascii():
            return
        found = {kind: 1.5 for kind, pattern in _STRING_PATTERNS.items() if pattern.search(folded)}
        if AIMED_STRINGS.search(folded) and WEAK_STRINGS.search(folded):
            found.setdefault("insult", 1.2)
        for kind, score in found.items():
            best[kind] = max(best[kind], score - 0.6 * bool(_STUDIED_STRINGS.search(folded)))

    def _sentence(self, tokens: list[str], at: int, reach: int = 14) -> tuple[int, int]:
        """First place and the place behind the last of the sentence around token ``at``, as far as ``reach``."""
        low = next((x + 1 for x in range(at - 1, max(0, at - reach - 1) - 1, -1) if tokens[x] in _ENDS), max(0, at - reach))
        high = next((x for x in range(at + 1, min(len(tokens), at + reach + 1)) if tokens[x] in _ENDS), min(len(tokens), at + reach + 1))
        return low, high

    def _score_terms(self, tokens: list[str], hits: list[tuple[int, tuple[tuple[int, bool], ...]]], best: dict[str, float]) -> None:
        """Single terms: an insult beside 'you' or with its adjective counts when nobody quotes or reports it."""
        if not any(i in self.is_insult for _, ids in hits for i, _ in ids):
            return
        by_place = {at: tuple(i for i, _ in ids) for at, ids in hits}
        for at, found in hits:
            if not any(i in self.is_insult for i, _ in found):
                continue
            low, high = self._sentence(tokens, at)
            around = [x for x in range(max(low, at - 4), min(high, at + 3)) if x != at]
            exact = any(sure and i in self.is_insult for i, sure in found)
            score = 0.3 if exact else 0.2
            if at and any(i in self.is_adjective for i in by_place.get(at - 1, ())):
                score += 0.5
            if any(i in self.is_aimed for x in around for i in by_place.get(x, ())):
                score += 0.5
            if at and tokens[at - 1] == "=" and (exact or at < 3 or tokens[at - 3] != "|"):
                score += 0.8
            if any(tokens[x] in _QUOTE for x in around):
                score -= 0.6
            score -= 0.3 * min(3, sum(1 for x in range(low, high) if any(i in self.is_reported for i in by_place.get(x, ()))))
            if score > 0:
                best["insult"] = max(best["insult"], score)


_SCORERS: dict[tuple, Scorer] = {}


def _score_partition(terms: tuple[tuple[str, str], ...], model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (terms, model)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(list(terms), pickle.loads(model))
        scorer = _SCORERS[key]
        for b in batches:
            done = [scorer.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            kept = [b.column(c) for c in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([s for s, _ in done], pa.float64()), pa.array([k for _, k in done], pa.string())], [*b.schema.names[:-1], "score", "category"])

    return run


def _extra_terms(terms: DataFrame | None, max_terms: int) -> list[tuple[str, str]]:
    if terms is None:
        return []
    extra = sorted((r.term, r.category or "") for r in terms.where(F.col("term").isNotNull()).select("term", "category").limit(max_terms + 1).collect())
    if len(extra) > max_terms:
        raise ValueError(f"more than {max_terms} terms")
    return extra


def _read_clauses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, doc, condemned, text) as one row for each clause of each document."""
    for b in batches:
        out: list[tuple[list[str], int, int, bool]] = []
        for g, d, bad, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            out.extend((list(c), g, d, bad) for c in clauses(text))
        c, g, d, bad = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.string())), pa.array(g, pa.int64()), pa.array(d, pa.int64()), pa.array(bad, pa.bool_())], ["clause", "grp", "doc", "bad"])


def _fit_partition(extra: list[tuple[str, str]], n_condemned: int, n_clean: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((tuple(c), sorted((x["grp"], x["doc"]) for x in docs), n) for b in batches for c, docs, n in zip(*(b.column(i).to_pylist() for i in range(3))))
        model = fit_wording(rows, n_condemned, n_clean, categories_of(extra), near_words)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def learn_wording(docs: DataFrame, judgements: DataFrame, id_col: str = "doc_id", verdict_col: str = "toxic", text_col: str = "text", group_col: str | None = None, terms: DataFrame | None = None, max_condemned: int = MAX_CONDEMNED, max_clean: int = MAX_CLEAN, max_terms: int = 10_000) -> Wording:
    """A model of abusive wordings from readers' judgements (id, verdict 1 or 0) of whole documents; runs at once.

    A document is condemned, or clean, when more than half of its verdicts are 1,
    or 0; ties and nulls say nothing. The sample is bounded: at most ``max_condemned``
    and ``max_clean`` documents, the first by a hash of the id. ``group_col`` names
    what documents share topics by, such as their page. Without condemned
    documents the model is empty. Ids are whole numbers.
    """
    extra = _extra_terms(terms, max_terms)
    share = judgements.where(F.col(verdict_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.avg(F.col(verdict_col).cast("double")).alias("m"))
    pick = lambda side, most, bad: share.where(side).orderBy(F.xxhash64("doc"), "doc").limit(most).select("doc", F.lit(bad).alias("bad"))
    chosen = pick(F.col("m") > 0.5, max_condemned, True).unionByName(pick(F.col("m") < 0.5, max_clean, False))
    group = F.coalesce(F.col(group_col), F.col(id_col)) if group_col else F.col(id_col)
    judged = docs.select(group.cast("long").alias("grp"), F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc").select("grp", F.col("doc").cast("long").alias("doc"), "bad", "text")
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    read = Cut(judged.repartitionByRange(tasks, "doc").mapInArrow(_read_clauses, "clause array<string>, grp long, doc long, bad boolean"), "clauses")
    sizes = {r.bad: r.n for r in read.df.groupBy("bad").agg(F.count_distinct("doc").alias("n")).collect()}
    met = read.df.groupBy("clause").agg(F.collect_list(F.when(F.col("bad"), F.struct("grp", "doc"))).alias("docs"), F.sum(F.when(F.col("bad"), 0).otherwise(1)).alias("n"))
    fitted = met.coalesce(1).mapInArrow(_fit_partition(extra, sizes.get(True, 0), sizes.get(False, 0)), "model binary").collect()
    read.drop()
    return pickle.loads(fitted[0].model) if fitted else Wording()


def score_texts(df: DataFrame, id_cols: list[str], text_col: str = "text", terms: DataFrame | None = None, wording: Wording | None = None, max_terms: int = 10_000) -> DataFrame:
    """(id columns, score, category) of every row; a null or empty text has score 0 and category ''.

    ``terms`` (term, category) adds to the lexicon; more than ``max_terms`` are
    an error, since the lexicon goes to every task. ``wording`` adds words and
    weights of their context learned from judgements. One pass, and
    no shuffle unless files are fewer than tasks; whole texts are read, markup and comments included. From ``FLAG_FROM`` on a
    document counts as a case.
    """
    rows = spread(df.select(*id_cols, text_col), id_cols[0])
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", score double, category string"
    return rows.mapInArrow(_score_partition(tuple(_extra_terms(terms, max_terms)), pickle.dumps(wording or Wording())), schema)


def rates(scored: DataFrame, by: str) -> DataFrame:
    """(by, n_documents, n_flagged, rate); a null source is a group of its own."""
    flagged = F.sum(F.when(F.col("score") >= FLAG_FROM, 1).otherwise(0)).cast("long")
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("n_documents"), flagged.alias("n_flagged")).withColumn("rate", F.round(F.col("n_flagged") / F.col("n_documents"), 6))
