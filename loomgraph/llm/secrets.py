"""Secret scans: three fixed patterns, and novelty under dictionary-primed zstandard.

The novelty method looks at unbroken strings near words of a sensitive context. It compresses the
text around a candidate without and with it, primed by a dictionary of identifiers and by that
surrounding text; the marginal bytes, as a share of what a random string of the same length and
alphabet costs, tell whether the string repeats known text. zstandard stores short literals raw,
so that share can't tell a new name from a key. It is multiplied by the bits of the string under
letter pairs of usual words, as a share of the bits of its alphabet. Names, words and repeated
values stay low, random keys of any alphabet come to 1 or more.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A maximal run is one match, so a shorter one can't hide a longer.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
#: Words of a sensitive context, patterns in lower case. 'author', 'tokenize',
#: 'secretary' and 'Slovakia' are other words; a key follows 'akia' without a border.
_END = r"s?(?![^\W\d_])"
_JOIN = r"[_\-\x20]?"
_COMPOUND = [f"{w}{_JOIN}key" for w in ("api", "access", "account", "auth", "client", "encryption", "master", "private", "secret", "service", "session", "shared", "signing", "ssh", "storage")] + [f"session{_JOIN}id", f"pass{_JOIN}phrase"]
_LONG = ["password", "passwd", "secret", "token", "credential", *_COMPOUND]
_SHORT = ["pwd", "auth2", "auth", "oauth2", "oauth", "authorization", "authorisation", "authentication", "bearer", "signature"]
# The left border stands after the word, so that each pattern begins with a letter: the search is
# ten times faster.
CONTEXT = [f"{w}{_END}" for w in _LONG] + [f"{w}(?<![^\\W\\d_]{w}){_END}" for w in _SHORT] + [r"akia(?<![^\W\d_]akia)"]
_CONTEXT = re.compile("|".join(CONTEXT))
#: The same words as humps of a camelCase name: authHeader, myAuth, tokenValue.
_ANY = re.compile("|".join(sorted(_LONG + _SHORT, key=len, reverse=True)))
#: Every context word has one of these.
_STEMS = ("passw", "secret", "token", "credential", "key", "session", "phrase", "pwd", "auth", "bearer", "signature", "akia")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Names that are usual in code and configuration.
IDENTIFIERS = """
access_key accessKey account address algorithm api_key apiKey application arguments array assert async attribute authorization auth_token backup base64 bearer boolean buffer
build bytes cache callback certificate class client_id client_secret cluster column command commit config configuration connection connection_string constructor container content-type
context cookie credentials database database_url debug default delete deploy description digest directory document domain email enabled encoding encrypted endpoint environment error example
exception expires export false field file filename filter float format function generate getElementById getString handler hash header headers hostname http https://www.example.com identifier import
index information input instance integer interface internal invalid iterator json key kubernetes language length library license localhost location logger login manager message metadata method
module name namespace network node not_a_secret null number object operation option output package parameter parse password path payload permission placeholder policy port prefix primary private_key
process production profile project properties protocol provider proxy public_key query random reference refresh_token region register release remote repository request required resource response result
return role root route sample schema secret secret_key security select self server service session session_id setting signature source static status storage string struct structure subscription
system table target temporary test_token thread timeout timestamp token transaction type undefined unknown update upload url user user_id username utf-8 validate value variable version volume webhook
aaaaaaaaaaaaaaaa xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef your_api_key_here changeme
"""
#: Words whose letters are usual, of names, paths and prose in four languages.
WORDS = """
about academy action active actor adapter after again agent agenda always american analysis android animal annual answer apache article artist asset association author authors available avenue
balance bank beacon because before begin better between binary block board book bottom branch bridge browser builder business button calendar camera canvas capital career catalog center central
chain change channel chapter character chart check child children church city civil claim clean click clock close cloud code collection college color com common community company compare complete
component computer concept condition conference consumer context control convert core corporation count country course court create creator culture currency current custom customer data date day
deep default define department design detail develop development device dialog different dimension dom direct discovery display doi driver duration dynamic early earth east economy edge edition editor
education effect electric element empire energy engine english entity entry equal estate european even event every evidence exchange execute factory family fast feature federal festival fetch
field final finance find first flight float flow folder font football force foreign forest forward foundation fragment frame framework free french friend front full future gallery game garden
gateway general geography german global gold google government graph great green ground group growth guide handle health height help high history holder home hospital hotel house human image
impact income index industry inside institute insurance international internet into island issue item java javascript job join journal jump just justice knowledge label language large last
later launch law layer layout leader league learning left legal level light line link linux list literature little loader local lock long loop machine machines magazine main make manage
manufacturing map mark market master match material math matrix mayor measure media medical meeting member memory menu merge method microsoft middle military mine minister mobile mode model modern
modules money monitor month more morning mount move movie multi museum music name nation national natural nature never new news next night normal north northern note notification number observer ocean
office official online open operator order organization origin other output over owner pack page pair panel paper parent park parser part partner party pattern people performance period
person phone photo physical pipeline plan planet platform play player plugin point police policy political pool popular position post power practice prepare present president press price
print private problem process product professor program project proof provide public pull push quality quarter query queue quick race radio random range rate reader ready real record red reduce
region relation remote render report republic request research reset resolve rest return review right river road rock roman root round route row rule runtime safe sample save scale scanner
schedule school science scope score screen script scroll search season second section sector select senate sender series session share sheet shop short show side signal simple single site size
social society software soldier solution some song sort sound source south space spark special speed sport spring stack stage standard star start state station step still stock stop story
strategy stream street strong student studio study style subject success summer support surface symbol system table task teacher team technology template term text than that their them theory
there these thing this thread three through time title today together tool total tower town track trade train transaction transfer transition transport travel tree trigger trust turn type under
union unit united university update user utility valid value vector version vertical video view village virtual visible vision voice wall want water weather week welcome west what when where
which while white widget width wild window winter with without woman wood word work worker world wrapper write year yellow young zero zone
aber abschnitt abteilung alle anfang arbeit auch aufgabe beispiel bereich bericht bild bundes bürger datei daten deutsch einstellung entwicklung ergebnis fehler forschung frage führung ganze gebiet
gemeinde gericht geschichte gesellschaft gesetz grenze haupt hoch jahr kirche konfiguration kraft krieg kunde land leben leitung mensch möglich nachricht neue nicht recht reich richtung schule
schlüssel schrift seite sicherheit sprache staat stadt straße stunde teil über unter verbindung verein verfahren verwaltung volk werk wert wirtschaft wissenschaft wort zeichen zeit zugang zusammen
accueil adresse affaire ancien année aussi autre avant bonjour chaque chemin chose compte comme connexion dans depuis développement donnée école enfant ensemble entre entreprise état être exemple
femme fichier fonction grand groupe guerre heure histoire homme jour jeune langue lettre lieu livre maison mairie message milieu monde montagne nombre notre nouveau ouvrage partie pays petit place
plusieurs pour premier prix projet quatre quelque question recherche réseau rue sans service siècle société sous suite sujet temps toujours travail trois utilisateur valeur ville voyage
ahora algunos ambiente amigo antes archivo ayuda bajo bueno cada calle camino campo casa ciudad clave clase como conocimiento contraseña cuando cuenta cuerpo cultura derecho desarrollo desde día
dinero donde empresa entonces equipo escuela español estado fecha forma fuente gobierno gente guerra hacia hasta historia hombre iglesia lengua libro lugar madre manera mayor mejor mientras mismo
muchos mujer mundo nombre noche nuevo número palabra parte película persona pequeño poder pueblo puerta punto quien reino respuesta semana sistema sobre tiempo tierra todo trabajo usuario varios vida
aes ajax api arm aws bean bin cdn cli cpu css csv dao dns dto exe ftp gcc gif git gnu gpu gui guid hmac html http https ibm impl io ip iso jar jpeg jpg js json jwt lib log md nio npm oauth org os pdf png
py rfc rsa sdk sha sql src ssl svg sys tcp tls tmp udp ui uri usr utf util utils uuid var www x xml yaml zip
"""
#: A candidate has SHORTEST characters or more, or SHORT with letters and digits. Letters of one
#: case without a digit could be a word of any language, so they need the share ONE_CASE.
WINDOW, NEAR, SHORTEST, SHORT, NOVELTY, ONE_CASE = 256, 48, 16, 10, 1.0, 1.4
_LONG_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORT},}}")
#: Between the lines of a block: quotes, a line break (or its escape), an indent or comment sign.
_GAP = re.compile(r"""["'+,;]*+(?:[^\S\n]*+["'+,;\\]*+[^\S\n]*+\n[\s"'+>#*|]*+|\\(?=n))""")
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_FINISH = re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY")
_BODY = re.compile(r"""[A-Za-z0-9+/=\s\\"',:;.()<>@#*|-]*""")
#: Humps, words in capitals, numbers and single signs.
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|.", re.DOTALL)
_SIGNS = "+/_=-"


class Words:
    """Bits of a string as words, numbers and signs, against those of its alphabet."""

    #: Bits to say what kind of piece comes next, of a sign, and of a number that
    #: stands alone.
    KIND, SIGN, NUMBER = 2.3, 1.0, 8.0

    def __init__(self, words: str):
        plain = str.maketrans("áéíóúñçèêàâôûîëïäöüß", "aeiounceeaaouieiaous")
        self.known = set(re.findall("[a-z]{2,}", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", words).translate(plain).lower()))
        self.known -= {w for w in self.known if len(set(w)) == 1 or w in string.ascii_lowercase}
        pairs = Counter(w[i : i + 2] for w in (f"^{k}$" for k in sorted(self.known)) for i in range(len(w) - 1))
        letters = Counter(p[1] for p in pairs.elements())
        first = Counter(p[0] for p in pairs.elements())
        total = letters.total() + 27
        even = {c: (letters[c] + 1) / total for c in string.ascii_lowercase + "$"}
        # A pair that never came has a share of its second letter's frequency.
        self.bits = {a + c: -math.log2((pairs[a + c] + 8 * even[c]) / (first[a] + 8)) for a in string.ascii_lowercase + "^" for c in even}
        self.word = math.log2(len(self.known))

    def cost(self, piece: str) -> float:
        w = f"^{piece.lower()}$"
        spelt = sum(self.bits[w[i : i + 2]] for i in range(len(w) - 1))
        return min(spelt, self.word) if piece.lower() in self.known else spelt

    @staticmethod
    def alphabet(value: str) -> str:
        body = [c for c in value if c not in _SIGNS]
        low, high, digit = (any(f(c) for c in body) for f in (str.islower, str.isupper, str.isdigit))
        if digit and low != high and set(map(str.lower, body)) <= set("0123456789abcdef"):
            return "0123456789abcdef" if low else "0123456789ABCDEF"
        return string.ascii_lowercase * low + string.ascii_uppercase * high + string.digits * digit

    def share(self, value: str) -> float:
        """1 or more for a random string, less for names, words and dates."""
        value = value.strip(_SIGNS)
        alphabet = self.alphabet(value)
        if not alphabet:
            return 0.0
        pieces = _PIECE.findall(value)
        bits = 0.0
        for i, p in enumerate(pieces):
            if p in _SIGNS:
                bits += self.SIGN
            elif p.isdigit():
                n = self.KIND + len(p) * math.log2(10)
                # Years, versions and counts: up to four digits between signs or at the border.
                alone = len(pieces) > 1 and (i == 0 or pieces[i - 1] in _SIGNS) and (i == len(pieces) - 1 or pieces[i + 1] in _SIGNS)
                bits += min(n, self.NUMBER) if alone and len(p) <= 4 else n
            else:
                bits += self.KIND + self.cost(p)
        return bits / (sum(c not in _SIGNS for c in value) * math.log2(len(alphabet)))


@lru_cache(1)
def _words() -> Words:
    return Words(IDENTIFIERS + WORDS)


@lru_cache(1 << 12)
def _random_like(length: int, alphabet: str) -> bytes:
    return "".join(random.Random(length).choices(alphabet, k=length)).encode()


class Novelty:
    """Marginal compressed bytes of a candidate as a share of a random string's of its length and
    alphabet, times its share of its alphabet's bits."""

    def __init__(self, level: int = 19):
        self.level = level
        self.dictionary = " ".join(IDENTIFIERS.split()).encode()
        self.words = _words()

    def ratio(self, before: str, candidate: str, after: str) -> float:
        share = self.words.share(candidate)
        if share < NOVELTY:  # the other factor is 1 at most
            return share
        # A fifth less than the random string's cost is still chance: short matches in the dictionary.
        around = zstandard.ZstdCompressionDict(self.dictionary + b" " + (before + " " + after).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(level=self.level, dict_data=around, write_content_size=False, write_checksum=False, write_dict_id=False)
        # The same frame without the candidate is the cost of the frame itself.
        empty = len(press.compress(b""))
        full = len(press.compress(_random_like(len(candidate), self.words.alphabet(candidate)))) - empty
        # However odd its letters, a string whose text is known is not new.
        return min(1.25, share) * min(1.0, max(0, len(press.compress(candidate.encode())) - empty) / max(1, 0.8 * full))


_novelty = Novelty()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _lowered(text: str) -> str:
    """``text`` in lower case, of the same length; empty if it has no context word."""
    low = text.lower()
    if not any(stem in low for stem in _STEMS):
        return ""
    if len(low) != len(text):  # a letter whose lower case has two code points
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    return low


def _humps(text: str, low: str):
    for m in _ANY.finditer(low):
        a, b = m.span()
        b += text[b : b + 1] == "s"
        left = not text[a - 1 : a].isalpha() or text[a - 1].islower() and text[a].isupper()
        if left and (not text[b : b + 1].isalpha() or text[b].isupper() and text[b - 1].islower()):
            yield a, b


def novel_spans(text: str, base: list[tuple[int, int, str]], threshold: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Spans of incompressible strings within NEAR characters after a context word, outside the
    base spans."""
    low = _lowered(text)
    base = sorted(base)
    out: list[tuple[int, int, str]] = []
    done = at_base = reach = 0
    for word in _CONTEXT.finditer(low):
        at, limit = max(done, word.end()), word.end() + NEAR
        # Runs of any length: the search ends at the first one beyond the limit, so that a long
        # text takes linear time.
        for m in _RUN.finditer(text, at) if at <= limit else ():
            a, b = m.span()
            if a > limit:
                break
            if b - a < SHORT:
                continue
            done = b
            # Candidates come in order: ``reach`` is where the base spans that start before b end.
            while at_base < len(base) and base[at_base][0] < b:
                reach = max(reach, base[at_base][1])
                at_base += 1
            if reach > a:
                continue
            if _is_new(text, a, b, threshold):
                out.append((a, b, "novel"))
    return out


def is_candidate(value: str) -> bool:
    if len(value) < SHORTEST:
        return len(value) >= SHORT and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    one_case = not any(c.isdigit() for c in value) and (value.islower() or value.isupper() or value.istitle())
    return not one_case or _novelty.words.share(value) >= ONE_CASE


def _is_new(text: str, a: int, b: int, threshold: float = NOVELTY) -> bool:
    value = text[a:b]
    return is_candidate(value) and _novelty.ratio(text[max(0, a - WINDOW) : a], value, text[b : b + WINDOW]) >= threshold


def beside_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What :func:`novel_spans` doesn't look at: strings that end within NEAR characters before a
    context word, and those near a word in a camelCase name; outside the spans ``taken``."""
    low = _lowered(text)
    words = sorted({m.span() for m in _CONTEXT.finditer(low)} | set(_humps(text, low)))
    if not words:
        return []
    taken, out = sorted(taken), []
    starts, ends = [a for a, _ in words], sorted(b for _, b in words)
    at = reach = 0
    for m in _LONG_RUN.finditer(text):
        # The words inside a run part it.
        inside = words[bisect_left(starts, m.start()) : bisect_left(starts, m.end())]
        a = m.start()
        for x, y in [*inside, (m.end(), m.end())]:
            lo, b, a = a, x, max(a, y)
            if b - lo < SHORT:
                continue
            while at < len(taken) and taken[at][0] < b:
                reach = max(reach, taken[at][1])
                at += 1
            after, before = bisect_left(starts, b), bisect_right(ends, lo) - 1
            near = after < len(starts) and starts[after] <= b + NEAR or before >= 0 and ends[before] >= lo - NEAR
            if near and reach <= lo and _is_new(text, lo, b):
                out.append((lo, b, "novel"))
    return out


def private_blocks(text: str) -> list[tuple[int, int, str]]:
    """The bodies of private keys between their BEGIN and END lines."""
    heads = list(_BEGIN.finditer(text)) if "-----BEGIN " in text else []
    if not heads:
        return []
    tails = [m.start() for m in _FINISH.finditer(text)]
    out = []
    for m, following in zip(heads, [*[h.start() for h in heads[1:]], len(text)], strict=True):
        i = bisect_left(tails, m.end())
        if i == len(tails) or tails[i] > following:
            continue  # a block without an end: its lines are found as adjoining runs
        body = _BODY.fullmatch(text, m.end(), tails[i])
        if body and any(_is_new(text, *r.span()) for r in _LONG_RUN.finditer(text, m.end(), tails[i])):
            a, b = m.end(), tails[i]
            while text[a].isspace():
                a += 1
            while text[b - 1].isspace():
                b -= 1
            out.append((a, b, "novel"))
    return out


def whole_blocks(text: str, seeds: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the new strings on the lines that adjoin a seed's, with the seed if it is novel."""
    runs = [m.span() for m in _RUN.finditer(text) if m.end() - m.start() >= 4]
    begins, out = [a for a, _ in runs], []

    def same(i: int, j: int, k: int) -> bool:
        """Whether run ``k`` goes on with the block of the runs i to j, next to it."""
        a, b = runs[k]
        if b - a >= SHORTEST:
            return _is_new(text, a, b)
        # A block's last line is shorter than the one before it.
        return k > j and runs[j][1] - runs[j][0] >= 2 * SHORTEST and (text[b - 1] == "=" or _novelty.words.share(text[a:b]) >= NOVELTY)

    last = -1
    for a, b, kind in sorted(seeds):
        i = j = bisect_right(begins, b - 1) - 1
        if j < 0 or j < last:
            continue
        while j + 1 < len(runs) and _GAP.fullmatch(text, max(b, runs[j][1]), runs[j + 1][0]) and same(i, j, j + 1):
            j += 1
            b = runs[j][1]
        begin = bisect_right(begins, a) - 1
        while kind == "novel" and begin == i and i - 1 > last and _GAP.fullmatch(text, runs[i - 1][1], a) and same(i, j, i - 1):
            i = begin = i - 1
            a = runs[i][0]
        first = a if kind == "novel" else runs[i + 1][0] if j > i else b
        if first < b:
            out.append((first, b, "novel"))
        last = j
    return out


def _joined(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), kind)
        else:
            out.append((a, b, kind))
    return out


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = sorted(base_spans(text), key=lambda x: (x[0], KINDS.index(x[2])))
    novel = novel_spans(text, base)
    novel += beside_spans(text, base + novel)
    seeds = novel + [s for s in base if s[2] == "assign"]
    if seeds:
        novel += whole_blocks(text, seeds)
    novel = _joined(novel + private_blocks(text))
    every = sorted(base + novel, key=lambda x: (x[0], KINDS.index(x[2])))
    return base, every


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """``text`` with ``mark`` for each run of overlapping spans."""
    parts, at, open_ = [], 0, 0
    for a, b, _ in sorted(spans):
        if a >= open_:
            parts += [text[at:a], mark]
        open_ = at = max(open_, b)
    return "".join([*parts, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>``: one row for each row; code points, end
    exclusive, by start, then kind. A null text counts as empty and has none. Null ids and
    repeated rows are kept; spans of different kinds may overlap; other columns are ignored; an
    empty table gives an empty result."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                rows.append([] if not text else [{"kind": k, "start": a, "end": b} for a, b, k in spans_of(text)[1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of its text replaced by a mark; all other columns stay, whatever
    their names. A null text stays null, an empty one empty; each row is read by itself, so null
    ids and repeated rows stay as they are; an empty table gives an empty result."""
    names, at = df.columns, df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t and redacted(t, spans_of(t)[1]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)

    return df.mapInArrow(run, df.schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts and digests of the spans, from :func:`scan`."""
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    line = lambda xs: F.concat_ws(",", F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
