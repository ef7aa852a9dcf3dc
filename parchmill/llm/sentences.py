"""Problem 2: sentence units of texts in any language or layout.

A text is cut into blocks (lines, or paragraphs where lines are wrapped). Inside a block, possible ends are the runs
of closing marks, and in Thai the spaces between letters. A semi-Markov dynamic program picks whole spans: each span
is scored by its length, the word that opens it, the word that closes it, and the balance of its quotation marks and
brackets: a span that begins or ends between a mark and its partner pays ``UNBALANCED``, more than any words can bring.

A span may have any length and hold any number of possible ends. Beyond ``ORDINARY`` characters its score falls evenly
with its length, so the best of all farther beginnings is one running maximum; work is linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .forms import GREEK_CYRILLIC, LATIN, TWINS, _klass, plain_table

ORDINARY = 400
UNBALANCED = 1e6
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
STOPS = ".!?…。！？｡।॥؟۔‼⁇⁈⁉።។။։"
#: Marks that end a sentence without a space after them.
HARD = "。｡।॥؟۔።។။։"
PAIRS = {"(": ")", "（": "）", "[": "]", "［": "］", "“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "{": "}", "‘": "’", "‚": "‘’"}
CLOSERS = "”»›)）]］」』】》〉}’\"'"
LETTERS = "[^\\W\\d_]"

#: Abbreviations after which a sentence goes on (without their last full stop).
GOES_ON = frozenset("""
Dr Mr Mrs Ms Mx Prof Messrs Mme Mmes Mlle MM Me Sr Sra Srta Dra Hr Hrn Fr Frl Dipl Ing St Ste Mt Gen Gov Sen Rep Col Capt Lt Sgt Maj Adm Cmdr Rev Hon Pres Supt Insp
Vol vol Vols Sec Secs sec Fig Figs fig figs pp p pg pgs ch Ch Chap chap Eq eq Ref ref Reg Regs Art art Arts Ziff Abs Nr Nrn nr Kap Bd Bde Hrsg Tab Abb Anm Anl Par par Para Exh Ex App
approx Approx aprox Aprox incl Incl excl est Est vs Vs VS v cf Cf viz e.g E.g i.e I.e ca Ca c ggf evtl inkl exkl bzw vgl Vgl sog gem lt max min Mio Mrd Tsd Str Tel tel zzgl abzgl geb gest
env Env av boul éd núm Núm n.º pág Pág págs Ud Uds Avda cap párr máx mín tel dept Dept ext Ext
т тт п пп ст см См ср ок ул им тыс млн млрд стр рис табл напр проф акад доц гл ч кв просп пер обл р-н г-н
د أ م ص ج डॉ श्री प्रो सं कु रु पृ लि लिमि
""".split())  # fmt: skip
#: Abbreviations that can end a sentence as well.
MAY_END = frozenset("""
Inc Ltd Co Corp Cos Bros Jr Esq Ph.D M.D LL.M etc usw Inh al ibid U.S U.K U.N E.U a.m p.m A.M P.M S.A S.A.S S.p.A S.L N.V B.V A.G L.P L.L.C L.L.P P.C P.L.C
г гг др руб коп лет pts pct No Nos Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec EE UU
""".split())  # fmt: skip
#: Of the abbreviations above, those that no name ends with.
NO_NAME = frozenset("a.m p.m A.M P.M etc usw Ph.D M.D U.S U.K U.N E.U al ibid".split())
#: Of the abbreviations above, those that may end a sentence in capitals as well.
PLAIN_ENDS = frozenset("a.m p.m etc usw ph.d m.d jr esq".split())
#: Abbreviations that go on if a figure follows.
BEFORE_FIGURE = frozenset("No Nos no nos Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec pts г".split())
#: Words that label the single letter after them.
LABELS = frozenset("schedule class series exhibit annex appendix part form section type grade plan tier vitamin group tranche category level phase column row item table option unit zone hepatitis".split())
#: Parts of a name that follow a company's abbreviation or mark.
NAME_PARTS = frozenset("inc ltd co corp corporation company limited plc llc lp group holdings holding partners bancorp gmbh ag kg s.a n.v b.v l.p s.p.a investor investors shareholder shareholders international".split())
#: Words that often open a sentence.
OPENERS = frozenset("""
The A An We Our In On At By For From It This That These Those There They If When While As After Before Since Until Under Although However Both Each Neither Either Of To With Did Does Do Is Are Was Were What Who Why How Where
Which He She You I See All No Not Some Most Many Half Results Pursuant According Historically
Der Die Das Ein Eine Wir Es In Im Am Für Hat Laut Über Gemäß Mit Bei Nach Vor Seit Auch Aber Wie
Le La Les L Un Une Nous Il Elle En Dans Pour Selon Depuis Près Quelle Quel Ce Cette Au Aux Sur Avec
El Los Las Una Según Desde Véase Con Por Para Esta Este Se
В По Мы Это Он Она Они Изменилась На С За Для Как Но И См Опрошено
""".split())  # fmt: skip
#: German months, and words before an ordinal number.
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
BEFORE_ORDINAL = frozenset("am Am im Im der Der die Die das Das dem den des vom Vom zum Zum beim bis ab seit zur".split())

_dropped = frozenset(c for c, v in plain_table().items() if not v)
_drop = re.compile(_klass(_dropped))
_view = {ord(c): v for c, v in plain_table().items() if len(v) == 1 and (v.isalnum() or v in " .") and c not in STOPS.replace("．", "")} | {ord(c): " " for c in "\t\r\x0b\x0c\x85\u2028\u2029"}
_special = re.compile(_klass(map(chr, _view)))
_plain = {chr(c): v for c, v in _view.items()}
_twins = {ord(c): t[0] for c, t in TWINS.items()}
_shut = re.escape(CLOSERS)
_end = re.compile(f"[{STOPS}]+(?:[{_shut}]*(?=[{CJK}])|[{_shut}“]*(?= |\n|$)| ?[»›]+(?= |\n|$)|(?<=[{HARD}！？])[{_shut}]*|(?<=[{CJK}][!?])[{_shut}]*|(?<=[!?])(?=[{CJK}]))")
_foreign = re.compile(f"[{GREEK_CYRILLIC}]")
_latin = re.compile(f"[{LATIN}]")
_word = re.compile(r"[^\W\d_]+")
_thai = re.compile("(?<=[ก-ฺเ-๎])[ \n]+(?=[ก-ฮเ-ๆ])")
_marks = re.compile('[' + "".join(map(re.escape, {*PAIRS, *"".join(PAIRS.values()), '"'})) + "]")
_paragraph = re.compile("\n[^\\S\n]*(?:\n[^\\S\n]*)+")
_numbered = re.compile(f"[\\W_]*(?:{LETTERS}+ +)?(?:[0-9]+(?:\\.[0-9]+)*|[IVXLivxl]+|[A-Za-z])$")
_lead = re.compile("[\\W_]+")
_spaces = re.compile("\\s*")
_initials = re.compile(f"(?:{LETTERS}\\.)+{LETTERS}$")


def _closed_pairs(block: str) -> list[tuple[int, int]]:
    """Outermost balanced pairs (opening, closing position) of quotation marks and brackets, in order."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {}  # closing mark -> depths of the open marks that it closes
    pairs: list[tuple[int, int]] = []
    for m in _marks.finditer(block):
        ch, at = m.group(), m.start()
        if ch == "’" and block[at + 1 : at + 2].isalpha():  # an apostrophe
            continue
        if waiting.get(ch):
            depth = waiting[ch][-1]
            opened = stack[depth][1]
            while len(stack) > depth:  # marks left open inside stay without a partner
                for partner in PAIRS.get(stack.pop()[0], '"'):
                    waiting[partner].pop()
            while pairs and pairs[-1][0] > opened:
                pairs.pop()
            pairs.append((opened, at))
        elif ch in PAIRS or ch == '"':
            for partner in PAIRS.get(ch, '"'):
                waiting.setdefault(partner, []).append(len(stack))
            stack.append((ch, at))
    return pairs


class _Inside:
    """Whether positions, asked in rising order, lie inside a balanced pair of a block."""

    def __init__(self, block: str) -> None:
        self.pairs, self.at = _closed_pairs(block) if _marks.search(block) else [], 0

    def __call__(self, position: int) -> bool:
        while self.at < len(self.pairs) and self.pairs[self.at][1] < position:
            self.at += 1
        return self.at < len(self.pairs) and self.pairs[self.at][0] < position


def _known(word: str, words: frozenset) -> bool:
    if word in words:
        return True
    if word.isupper() and len(word) > 1 and (word.capitalize() in words or word.lower() in words):
        return True
    return not word.isascii() and _looks_known(word, words)


@lru_cache(maxsize=100_000)
def _looks_known(word: str, words: frozenset) -> bool:
    word = unicodedata.normalize("NFKC", word)
    return word in words or word.translate(_twins) in words


def _bare(word: str) -> str:
    return word.strip("([“„«\"'.,;:!?)").lower()


def _opening(nxt: str) -> float:
    """How well a word opens a sentence."""
    bare = nxt
    if nxt and not nxt[0].isalnum():
        lead = _lead.match(nxt)
        bare = nxt[lead.end() :] if lead else nxt
        if nxt[0] in "|—–/=+*,;:&@#":
            return -6
    ch = bare[:1]
    if not ch:
        return -3 if nxt[:1] in "|—–-" else 0.5
    if ch.isdigit():
        return 1.5
    if ch.isupper():
        return 5 if bare.rstrip(",.:;?!") in OPENERS or (not bare.isascii() and bare.translate(_twins).rstrip(",.:;?!") in OPENERS) else 3
    if ch.islower():
        return 3 if bare[1:2].isupper() else -4.5
    return 3


def _closing(block: str, stop: int, marks: str, nxt: str, gap: bool) -> float:
    """How well the word before ``stop``, with its marks, closes a sentence before ``nxt``."""
    if any(m in HARD for m in marks):
        return -9 if not gap and block[stop + len(marks)] in CLOSERS and nxt[:1] in "，、と" else 9
    if any(m in "！？!?" for m in marks) and (not gap or (stop and block[stop - 1] > "⺀")):
        return 9
    cut = block.rfind(" ", 0, stop) + 1
    word = block[cut:stop]
    if marks == ".":
        pass
    elif "." not in marks and "…" not in marks and "．" not in marks:
        return -9 if word[:1].isupper() and marks in "!！" and _known(_bare(nxt), NAME_PARTS) else 4
    elif "!" in marks or "?" in marks:
        return 4
    elif marks.count(".") > 1 or "…" in marks:
        return 0.5
    if word and not word[0].isalnum():
        word = word[_lead.match(word).end() :] if _lead.match(word) else word
    if not word:
        return 3 if cut else -6
    last = word[-1]
    if last.isdigit() or stop < 24:
        if _numbered.match(block, 0, stop):
            return -12
    if last.isdigit():
        if len(word) <= 2 and nxt[:1].isupper():
            before = block[block.rfind(" ", 0, cut - 1) + 1 : cut - 1] if cut else ""
            if nxt.rstrip(",.") in MONTHS or before in BEFORE_ORDINAL:
                return -9
        return 3
    if len(word) > 12:
        return 3
    if _known(word, BEFORE_FIGURE) and nxt[:1].isdigit():
        return -12
    if _known(word, GOES_ON):
        return -12
    shouting = len(word) > 1 and word.isupper() and nxt[:2].isupper() and len(nxt) > 1 and nxt not in ("A", "I")
    if len(word) == 1 and last.isalpha():
        before = block[block.rfind(" ", 0, cut - 1) + 1 : cut - 1] if cut else ""
        if last.islower() and not _known(word, MAY_END):
            return -6
        if before.lower().translate(_twins).lstrip("(“\"") in LABELS:
            return 3
        if before[-1:] == "." or not before:
            return -9
        if ord(last) > 0x2FF and not (last.isupper() or last.islower()):
            return 3
        return -4 if not _known(word, MAY_END) else -1
    if _known(word, MAY_END) or _initials.match(word):
        if word not in NO_NAME and _bare(nxt) in NAME_PARTS:
            return -9
        return -1 if not shouting or word.lower() in PLAIN_ENDS or nxt.capitalize() in OPENERS else -8
    if "ऀ" <= last <= "ॿ":
        return 1 if len(word) > 4 else -6
    return 3


def _length(chars: int) -> float:
    return -4 if chars < 3 else -1 if chars < 8 else 0 if chars <= ORDINARY else (ORDINARY - chars) / ORDINARY


def _cuts(block: str, thai: bool) -> list[tuple[int, int]]:
    """Spans of a block: its best sequence of whole sentences."""
    size, ends = len(block), []
    inside = None
    for m in _end.finditer(block):
        end = m.end()
        start = _spaces.match(block, end).end()
        if start >= size:
            break
        if inside is None:
            inside = _Inside(block)
        if inside(end):
            ends.append((end, start, -UNBALANCED))
            continue
        marks = m.group()
        stop = block.find(" ", start)
        nxt = block[start : stop if stop > 0 else size]
        weight = _closing(block, m.start(), marks.rstrip(CLOSERS + "“ "), nxt, start > end)
        if weight < 8:
            if weight < -7:
                continue
            weight += _opening(nxt)
        ends.append((end, start, weight))
    if thai and (gaps := list(_thai.finditer(block))):
        inside = _Inside(block)
        ends = sorted(ends + [(m.start(), m.end(), -UNBALANCED if inside(m.start()) else 5.0) for m in gaps])
    if not ends:
        return [(0, size)]
    # An end of positive weight between stretches of ordinary length is in every best path: cutting there costs no
    # length score, whatever spans surround it. The program has to decide only between such ends.
    spans, first, held, last = [], 0, [], 0
    for k, (end, start, weight) in enumerate(ends):
        reach = ends[k + 1][0] if k + 1 < len(ends) else size
        if weight > 0 and end - last >= 8 and reach - start >= 8:
            spans += _best(first, held, end)
            first, held = start, []
        else:
            held.append((end, start, weight))
        last = start
    return spans + _best(first, held, size)


def _best(first: int, ends: list[tuple[int, int, float]], size: int) -> list[tuple[int, int]]:
    """Semi-Markov program: the sequence of spans of [first, size) with the greatest sum of scores."""
    if not ends:
        return [(first, size)]
    starts = [first, *(s for _, s, _ in ends)]
    closes = [*((e, w) for e, _, w in ends), (size, 0.0)]
    best, back = [0.0], [0]
    far, far_top, far_at = 0, -1e18, 0  # beginnings more than an ordinary length away, and the best of them
    for j, (end, weight) in enumerate(closes):
        while far < j and end - starts[far] > ORDINARY:
            if best[far] + starts[far] / ORDINARY >= far_top:
                far_top, far_at = best[far] + starts[far] / ORDINARY, far
            far += 1
        top, at = -1e18, j
        for i in range(j, far - 1, -1):
            score = best[i] + _length(end - starts[i])
            if score > top:
                top, at = score, i
        if far and far_top + (ORDINARY - end) / ORDINARY > top:
            top, at = far_top + (ORDINARY - end) / ORDINARY, far_at
        best.append(top + weight)
        back.append(at)
    spans, j = [], len(closes)
    while j:
        i = back[j]
        spans.append((starts[i], closes[j - 1][0]))
        j = i
    return spans[::-1]


def units(text: str, wrapped: bool = False) -> list[tuple[int, int]]:
    """[start, end) of each sentence unit, in code points. ``wrapped``: only blank lines end a block."""
    view, kept = text, None
    if not text.isascii():
        if _drop.search(text):
            kept = [i for i, ch in enumerate(text) if ch not in _dropped]
            view = "".join([text[i] for i in kept])
    if _special.search(view):
        view = _special.sub(lambda m: _plain[m.group()], view)
    if _foreign.search(view) and _latin.search(view):
        view = _word.sub(lambda m: m.group() if m.group().isascii() or not _latin.search(m.group()) else m.group().translate(_twins), view)
    thai = not view.isascii() and _thai.search(view) is not None
    out: list[tuple[int, int]] = []
    blocks = []
    at, size = 0, len(view)
    if wrapped:
        for m in _paragraph.finditer(view):
            blocks.append((at, m.start()))
            at = m.end()
        blocks.append((at, size))
    else:
        while (stop := view.find("\n", at)) >= 0:
            if stop > at:
                blocks.append((at, stop))
            at = stop + 1
        blocks.append((at, size))
    for first, last in blocks:
        block = view[first:last]
        bare = block.lstrip()
        if not bare:
            continue
        first += len(block) - len(bare)
        bare = bare.rstrip()
        if wrapped and "\n" in bare:
            bare = bare.replace("\n", " ")
        held = -1
        for a, b in _cuts(bare, thai):
            if not _alnum.search(bare, a, b):  # marks alone belong to a neighbour
                if out and held >= 0:
                    out[-1] = (out[-1][0], first + b)
                elif held < 0 and b < len(bare):
                    held = -2 - a
                continue
            if held < -1:
                a = -2 - held
            held = 0
            while bare[b - 1].isspace():
                b -= 1
            out.append((first + a, first + b))
    if kept is not None:
        return [(kept[a], kept[b - 1] + 1) for a, b in out]
    return out


_alnum = re.compile("[^\\W_]")


def sentence_units(df: DataFrame, key: str = "record_id", text: str = "core_text", wrapped=None) -> DataFrame:
    """(key, unit_start, unit_end): one row per unit. ``wrapped`` is a column: true where lines are wrapped.

    Null, empty and blank texts, and texts without a letter or digit, have no units.
    """
    kind = dict(df.select(key).dtypes)[key]
    flag = F.coalesce(wrapped if wrapped is not None else F.lit(False), F.lit(False))
    source = df.select(F.col(key), F.col(text).alias("__text"), flag.alias("__wrapped")).filter(F.col("__text").isNotNull())

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, starts, ends = [], [], []
            for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = units(t, w) if t else ()
                counts.append(len(spans))
                for a, b in spans:
                    starts.append(a)
                    ends.append(b)
            index = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            return pa.RecordBatch.from_arrays([batch.column(0).take(index), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "unit_start", "unit_end"])

        return step

    return map_batches(source, make, f"`{key}` {kind}, unit_start long, unit_end long")


def record_units(records: DataFrame) -> DataFrame:
    """The units of raw records; lines are wrapped where ``file_container_type`` is ``txt``."""
    return sentence_units(records, "record_id", "core_text", F.lower(F.col("metadata.filing.file_container_type")) == "txt")


def unit_texts(df: DataFrame, key: str, text: str, units_of: DataFrame) -> DataFrame:
    """(key, unit_start, unit_end, unit): the units with their text (a shuffle join on the key)."""
    whole = df.select(F.col(key), F.col(text).alias("__text"))
    return units_of.join(whole, key).select(key, "unit_start", "unit_end", F.expr("substring(__text, int(unit_start) + 1, int(unit_end - unit_start))").alias("unit"))
