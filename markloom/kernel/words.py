"""Unicode words, slugs, emoji names, URLs."""

from __future__ import annotations

import os
import re
import unicodedata
import zipfile
from collections import Counter
from functools import lru_cache
from pathlib import Path

import regex

BOUNDARY = regex.compile(r"\b", regex.WORD)
#: ASCII prose without signs that join or part words in special ways.
SIMPLE = re.compile(r"[A-Za-z0-9 \n]*")
SIMPLE_WORD = re.compile(r"[A-Za-z0-9]+")


def segments(text: str) -> list[str]:
    """The text cut at all its word boundaries (UAX 29)."""
    edges = sorted({0, len(text), *(m.start() for m in BOUNDARY.finditer(text))})
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def is_word(segment: str) -> bool:
    return any(map(str.isalnum, segment))


def count_words(text: str) -> int:
    if SIMPLE.fullmatch(text):
        return len(SIMPLE_WORD.findall(text))
    return sum(map(is_word, segments(text)))


#: How letters without a decomposition are written in ASCII.
LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z",
    "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i",
    "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s",
    "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "і": "i", "ї": "yi", "є": "ie", "ґ": "g", "ў": "u", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "tsh", "џ": "dzh",
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z",
    "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "", "غ": "gh", "ف": "f", "ق": "q", "ك": "k",
    "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y", "ى": "a", "ة": "h", "ء": "", "پ": "p", "چ": "ch", "ژ": "zh", "گ": "g", "ک": "k", "ی": "y",
    "א": "", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "kh", "ט": "t", "י": "y", "כ": "k", "ך": "k",
    "ל": "l", "מ": "m", "ם": "m", "נ": "n", "ן": "n", "ס": "s", "ע": "", "פ": "p", "ף": "p", "צ": "ts", "ץ": "ts", "ק": "q", "ר": "r", "ש": "sh", "ת": "t",
    "⁄": "/",
}
#: Kana whose spelling is not that of their name.
KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}
INDIC = "DEVANAGARI|BENGALI|GURMUKHI|GUJARATI|ORIYA|TAMIL|TELUGU|KANNADA|MALAYALAM|SINHALA"
SPELLED = re.compile(rf"(?:(HANGUL SYLLABLE)|(HIRAGANA|KATAKANA) LETTER(?: SMALL)?|(?:{INDIC}) (?:(LETTER)|VOWEL SIGN)) ([A-Z]+)$")
READING = re.compile(r"\[([^\[\]→;]+)\]→([^\W\d_]+);")


@lru_cache(maxsize=1)
def han() -> dict[str, str]:
    """Chinese characters with their usual reading, from the transliteration rules of the Unicode
    library that Spark brings along: `[characters]→reading;`. Empty where that library is missing."""
    home = Path(os.environ.get("SPARK_HOME") or Path(__import__("pyspark").__file__).parent)
    for jar in sorted(home.glob("jars/icu4j-*.jar")):
        with zipfile.ZipFile(jar) as files:
            names = [n for n in files.namelist() if n.endswith("/translit/root.res")]
            rules = files.read(names[0]).decode("utf-16-be", "ignore") if names else ""
        found: dict[str, str] = {}
        for group, reading in READING.findall(rules):
            plain = "".join(x for x in unicodedata.normalize("NFKD", reading) if x.isascii() and x.isalpha()).lower()
            if plain:
                found |= dict.fromkeys(group, plain)
        return found
    return {}


@lru_cache(maxsize=8192)
def ascii_of(c: str) -> str:
    """A character in ASCII: as the table above says, else by its base letters, else as its reading
    or its name tells. Chinese characters are words of their own."""
    low = c.lower()
    if low in LETTERS:
        return LETTERS[low]
    parts = unicodedata.normalize("NFKD", low)
    plain = "".join(x if x.isascii() else LETTERS.get(x, "") for x in parts)
    if plain:
        return plain
    if unicodedata.category(c) == "Lo" and (reading := han().get(c)):
        return reading + " "
    name = unicodedata.name(c, "")
    if m := SPELLED.match(name):
        spelled = m[4].lower()
        if m[2]:
            return KANA.get(spelled, spelled)
        # an Indic consonant's name ends in the vowel that only its reading has
        return spelled[:-1] if m[3] and len(spelled) > 1 and spelled[-1] == "a" and spelled[0] not in "aeiou" else spelled
    if name.startswith("VARIATION") or unicodedata.category(c)[0] == "M":
        return ""
    if unicodedata.category(c) == "So":
        return name.lower()
    return " "


def slugify(text: str) -> str:
    """Lower-case ASCII letters and digits; every run of anything else is one dash."""
    if not text.isascii():
        text = "".join(c if c.isascii() else ascii_of(c) for c in text)
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


class Slugs:
    """Slugs of one document: the first bare, later ones numbered by base."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def take(self, text: str) -> str:
        base = slugify(text)
        if not base:
            return ""
        n = self.seen.get(base, 0)
        self.seen[base] = n + 1
        return f"{base}-{n}" if n else base


#: Shortcodes that are not the Unicode name of their character.
SHORTCODES = {
    "+1": "\U0001f44d", "thumbsup": "\U0001f44d", "-1": "\U0001f44e", "thumbsdown": "\U0001f44e", "tada": "\U0001f389", "100": "\U0001f4af",
    "smile": "\U0001f604", "smiley": "\U0001f603", "grin": "\U0001f601", "laughing": "\U0001f606", "joy": "\U0001f602", "wink": "\U0001f609",
    "blush": "\U0001f60a", "heart_eyes": "\U0001f60d", "sunglasses": "\U0001f60e", "thinking": "\U0001f914", "cry": "\U0001f622", "sob": "\U0001f62d",
    "heart": "❤️", "broken_heart": "\U0001f494", "star": "⭐", "sparkles": "✨", "fire": "\U0001f525", "zap": "⚡",
    "warning": "⚠️", "white_check_mark": "✅", "heavy_check_mark": "✔️", "x": "❌", "bulb": "\U0001f4a1", "memo": "\U0001f4dd",
    "book": "\U0001f4d6", "books": "\U0001f4da", "mag": "\U0001f50d", "lock": "\U0001f512", "key": "\U0001f511", "bell": "\U0001f514", "gear": "⚙️",
    "hammer": "\U0001f528", "wrench": "\U0001f527", "package": "\U0001f4e6", "ship": "\U0001f6a2", "recycle": "♻️", "boom": "\U0001f4a5",
    "clap": "\U0001f44f", "wave": "\U0001f44b", "muscle": "\U0001f4aa", "pray": "\U0001f64f", "ok_hand": "\U0001f44c", "point_right": "\U0001f449",
    "eyes": "\U0001f440", "coffee": "☕", "beer": "\U0001f37a", "pizza": "\U0001f355", "dog": "\U0001f436", "cat": "\U0001f431", "bug": "\U0001f41b",
    "sunny": "☀️", "cloud": "☁️", "umbrella": "☔", "snowflake": "❄️", "earth_africa": "\U0001f30d", "moon": "\U0001f314",
    "calendar": "\U0001f4c6", "chart_with_upwards_trend": "\U0001f4c8", "email": "✉️", "phone": "☎️", "computer": "\U0001f4bb",
    "art": "\U0001f3a8", "construction": "\U0001f6a7", "lipstick": "\U0001f484", "rotating_light": "\U0001f6a8", "see_no_evil": "\U0001f648",
    "question": "❓", "exclamation": "❗", "information_source": "ℹ️", "arrow_right": "➡️", "arrow_left": "⬅️",
    "smirk": "\U0001f60f", "stuck_out_tongue": "\U0001f61b", "kissing_heart": "\U0001f618", "hankey": "\U0001f4a9", "poop": "\U0001f4a9", "shit": "\U0001f4a9",
    "cop": "\U0001f46e", "e-mail": "\U0001f4e7", "o": "⭕", "white_flag": "\U0001f3f3️", "santa": "\U0001f385", "rofl": "\U0001f923", "scream": "\U0001f631",
    "stuck_out_tongue_winking_eye": "\U0001f61c", "relaxed": "☺️", "disappointed": "\U0001f61e", "confused": "\U0001f615", "angry": "\U0001f620", "rage": "\U0001f621",
    "sleeping": "\U0001f634", "innocent": "\U0001f607", "neutral_face": "\U0001f610", "unamused": "\U0001f612", "sweat_smile": "\U0001f605", "kiss": "\U0001f48b",
    "point_left": "\U0001f448", "point_up": "☝️", "point_down": "\U0001f447", "raised_hands": "\U0001f64c", "v": "✌️", "fist": "✊", "hand": "✋",
    "car": "\U0001f697", "airplane": "✈️", "house": "\U0001f3e0", "apple": "\U0001f34e", "cake": "\U0001f370", "gift": "\U0001f381", "trophy": "\U0001f3c6",
    "pencil": "\U0001f4dd", "pencil2": "✏️", "scissors": "✂️", "link": "\U0001f517", "clipboard": "\U0001f4cb", "pushpin": "\U0001f4cc", "paperclip": "\U0001f4ce",
    "iphone": "\U0001f4f1", "camera": "\U0001f4f7", "tv": "\U0001f4fa", "watch": "⌚", "hourglass": "⌛", "alarm_clock": "⏰", "no_entry": "⛔",
    "checkered_flag": "\U0001f3c1", "triangular_flag_on_post": "\U0001f6a9", "black_heart": "\U0001f5a4", "yellow_heart": "\U0001f49b", "100_percent": "\U0001f4af",
    "heavy_plus_sign": "➕", "heavy_minus_sign": "➖", "heavy_multiplication_x": "✖️", "copyright": "©️", "registered": "®️", "tm": "™️",
    "arrow_up": "⬆️", "arrow_down": "⬇️", "arrow_forward": "▶️", "arrow_backward": "◀️", "ok": "\U0001f197", "new": "\U0001f195", "free": "\U0001f193", "cool": "\U0001f192", "sos": "\U0001f198",
}
#: Shortcodes of flags, by the two letters that the flag is made of.
FLAGS = {"us": "US", "de": "DE", "cn": "CN", "es": "ES", "fr": "FR", "gb": "GB", "uk": "GB", "it": "IT", "jp": "JP", "kr": "KR", "ru": "RU"}
CODE = re.compile(r":([a-z0-9_+-]+):")


@lru_cache(maxsize=8192)
def emoji(name: str) -> str | None:
    """The emoji of a shortcode: from the table, else the pictograph with that Unicode name."""
    if name in SHORTCODES:
        return SHORTCODES[name]
    if name in FLAGS:
        return "".join(chr(0x1F1E6 + ord(c) - ord("A")) for c in FLAGS[name])
    try:
        c = unicodedata.lookup(name.replace("_", " "))
    except KeyError:
        return None
    return c if len(c) == 1 and unicodedata.category(c) == "So" and ord(c) >= 0x1F300 else None


def replace_emoji(text: str) -> str:
    """Known shortcodes replaced; the colon that ends a failed one may begin the next."""
    if ":" not in text:
        return text
    out, at = [], 0
    while m := CODE.search(text, at):
        found = emoji(m[1])
        if found:
            out += [text[at : m.start()], found]
            at = m.end()
        else:
            out.append(text[at : m.end() - 1])
            at = m.end() - 1
    return "".join(out) + text[at:]


#: Schemes whose URLs always have a host.
SPECIAL = ("http", "https", "ws", "wss", "ftp")
SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")


@lru_cache(maxsize=8192)
def split_url(url: str) -> tuple[str | None, str | None]:
    """Scheme and host of an absolute URL, lower-cased; (None, None) if it is not one."""
    url = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    m = SCHEME.match(url)
    if not m:
        return None, None
    scheme, rest = m[1].lower(), url[m.end() :]
    if scheme in SPECIAL:
        rest = rest.replace("\\", "/").lstrip("/")
    elif rest.startswith("//"):
        rest = rest[2:]
    else:
        return scheme, None
    place = re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2]
    host = place if place.startswith("[") else place.partition(":")[0]
    if not host:
        return (None, None) if scheme in SPECIAL else (scheme, None)
    if scheme in SPECIAL and re.search(r"[\s<>^|%]", host):
        return None, None
    return scheme, host.lower()


@lru_cache(maxsize=256)
def host_pattern(globs: tuple[str, ...]) -> re.Pattern:
    """The globs as one expression: * any run, ? any character, [..] a class, {a,b} alternatives."""
    parts = []
    for glob in globs:
        out, depth, i = [], 0, 0
        while i < len(glob):
            c = glob[i]
            if c == "*":
                out.append(".*")
            elif c == "?":
                out.append(".")
            elif c == "{":
                depth += 1
                out.append("(?:")
            elif c == "}" and depth:
                depth -= 1
                out.append(")")
            elif c == "," and depth:
                out.append("|")
            elif c == "[":
                end = glob.find("]", i + 2)
                if end < 0:
                    raise ValueError(f"invalid host pattern: {glob!r}")
                body = glob[i + 1 : end]
                out.append("[" + ("^" + re.escape(body[1:]) if body[0] in "!^" else re.escape(body).replace(r"\-", "-")) + "]")
                i = end
            else:
                out.append(re.escape(c))
            i += 1
        if depth:
            raise ValueError(f"invalid host pattern: {glob!r}")
        parts.append("".join(out))
    return re.compile("|".join(f"(?:{p})" for p in parts) or r"(?!)")


def host_allowed(url: str, globs: tuple[str, ...]) -> bool:
    host = split_url(url)[1]
    return host is None or bool(host_pattern(globs).fullmatch(host))


def scheme_allowed(url: str, schemes: tuple[str, ...]) -> bool:
    scheme = split_url(url)[0]
    return scheme is None or scheme in schemes


def is_external(url: str) -> bool:
    head, mark, _ = url.partition("://")
    return bool(mark) and head.lower() in ("http", "https")


#: Frequent words by which a language shows.
FREQUENT = {
    "eng": "the of and to in is that for it was with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three",
    "deu": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine seiner worden will zwischen immer was sagte gibt alle seit muss doch jetzt waren drei neue damit bereits da ihr seinen einmal ohne",
    "fra": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais ou avec son ont aux d'un cette d'une ses nous comme sa elle deux leur bien tout fait sans aussi peut encore lui ces ans avait on je vous entre sous dont faire si etre avoir meme quand tous ils autre alors depuis apres tres donc contre avant jour peu temps moins annees fois notre monde nos",
    "spa": "de la que el en y a los del se las por un para con no una su al lo como mas pero sus le ya o este si porque esta entre cuando muy sin sobre tambien me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto antes algunos que unos yo otro otras otra el tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros",
    "ita": "di che è e la il un per in non una sono ho lo ma con si le cosa come ci da questo qui del della nel alla gli anche più dei delle degli questa sul quando molto essere stato tra suo sua loro",
    "por": "de o que e do da em um para é com não uma os no na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas esse eles estão você",
    "nld": "de het een en van ik te dat die in je niet zijn is was op aan met als voor er maar om hem dan zou wat mijn men dit zo door over ze zich bij ook tot uit naar heeft kan nog geen worden deze werd veel hun haar wel",
    "swe": "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av mig du henne då sin nu har inte hans honom skulle hennes där min man vid kunde något från ut när efter upp vi dem vara vad över",
    "dan": "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når",
    "pol": "i w na z do się nie że to jest o jak za po co dla od ale czy tym już tak przez był są która które który może tylko jego jej ich być było bez także przed lub oraz",
    "ces": "a se v na je že o s z do i to jsem jako za by ale si po jak k ve tak jeho byl který pro co jen už od při které však být není nebo",
    "ron": "de și în a la cu nu o că pe un din se mai este care sunt ce pentru am fost să ca lui sau dar până prin după",
    "tur": "bir ve bu da de için ne çok ile gibi daha ama var olarak kadar sonra en ben o ki mi olan değil her",
    "fin": "ja on ei se että oli hän en ole mutta mitä niin kun kuin myös joka ovat sen tämä olen sitä hänen vain tai jos",
    "hun": "a az és hogy nem is egy ez azt van volt meg csak de ki már még ha mint el vagy lesz",
    "ind": "yang dan di itu dengan untuk tidak ini dari dalam akan pada juga saya ke karena tersebut bisa ada mereka lebih telah",
}
#: The languages that a frequent word speaks for.
WORD_LANGUAGES: dict[str, list[str]] = {}
for _language, _words in FREQUENT.items():
    for _word in sorted(set(_words.split())):
        WORD_LANGUAGES.setdefault(_word, []).append(_language)
LANGUAGE_LETTERS = {
    "deu": "äöüß", "fra": "èêàçœùîô", "spa": "ñíóú¿¡á", "ita": "òì", "por": "ãõ", "swe": "åäö", "dan": "æøå", "pol": "ąćęłńśźż",
    "ces": "ěščřžůý", "ron": "ășț", "tur": "ğış", "hun": "őű",
}
#: The usual language of a script; letters by which others show.
SCRIPTS = {
    "CYRILLIC": "rus", "GREEK": "ell", "HEBREW": "heb", "ARABIC": "ara", "DEVANAGARI": "hin", "CJK": "cmn", "HIRAGANA": "jpn", "KATAKANA": "jpn",
    "HANGUL": "kor", "THAI": "tha", "BENGALI": "ben", "GUJARATI": "guj", "GURMUKHI": "pan", "TAMIL": "tam", "TELUGU": "tel", "KANNADA": "kan",
    "MALAYALAM": "mal", "SINHALA": "sin", "KHMER": "khm", "MYANMAR": "mya", "GEORGIAN": "kat", "ARMENIAN": "hye", "ETHIOPIC": "amh", "ORIYA": "ori",
}
SCRIPT_LETTERS = {"CYRILLIC": (("ukr", "їєґ"), ("bel", "ў"), ("mkd", "ѓќ"), ("srp", "ђћ")), "ARABIC": (("pes", "پچژگ"), ("urd", "ٹڈڑے"))}


@lru_cache(maxsize=8192)
def script_of(c: str) -> str:
    """The first word of a letter's Unicode name."""
    return unicodedata.name(c, "?").partition(" ")[0]


def detect_language(text: str) -> tuple[str | None, float | None]:
    """The likely language (ISO 639-3) of a text, and how far it leads from 0 to 1; None where nothing
    speaks for any. The script that most letters are of tells many; Latin letters go by words."""
    low = text.lower()
    scripts = Counter(script_of(c) for c in low if c.isalpha()) if not low.isascii() else {}
    other = {s: n for s, n in scripts.items() if s != "LATIN"}
    if other and sum(other.values()) > scripts.get("LATIN", 0):
        script = max(sorted(other), key=lambda s: other[s] * (3 if s in ("HIRAGANA", "KATAKANA") else 1))
        found = SCRIPTS.get(script)
        for code, own in SCRIPT_LETTERS.get(script, ()):
            if any(c in own for c in low):
                found = code
        return (found, sum(other.values()) / sum(scripts.values())) if found else (None, None)
    words = re.findall(r"[^\W\d_]+", low)
    scores = dict.fromkeys(FREQUENT, 0.0)
    for w in words:
        for k in WORD_LANGUAGES.get(w, ()):
            scores[k] += 1
    if not text.isascii():  # none of the letters is
        for k, letters in LANGUAGE_LETTERS.items():
            scores[k] += 0.5 * sum(text.count(c) for c in letters)
    best, second = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]
    if not best[1]:
        return None, None
    return best[0], (best[1] - second[1]) / best[1]
