"""The one form of texts that look the same (problem 5).

Characters that readers cannot tell apart are written in one way:

* invisible characters vanish, other single spaces become a space, other hyphens ``-``;
* wide and narrow characters, presentation forms and joined letters become the plain letters;
* accents are composed (NFC);
* in a Latin word a Greek or Cyrillic letter becomes its Latin twin.

Every word that holds any such character is spelled by walking a trie of a public tokenizer's vocabulary with a
weighted edit automaton: look-alikes and invisible characters cost nothing, the second of two Latin twins a little, and
other edits 1 each, which is more than a spelling may cost, as different letters don't look the same. Words that the
trie doesn't hold go by the table. Words of look-alikes only are spelled where their line reads Latin.
Upper and lower case, accents and superscripts stay different, and ASCII text is never changed.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from functools import lru_cache

#: Hyphens that look like "-".
HYPHENS = "‐‑֊⁃﹣－"
#: Visible characters of category Cf (number and verse signs).
VISIBLE_FORMAT = [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2]
#: Invisible characters outside category Cf.
INVISIBLE_OTHER = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Cyrillic and Greek letters and their Latin twins; where two Latin letters look the same, the first is the table's.
TWINS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "Il", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "Il",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "lI",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "Il", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
}
#: Decompositions that only change how wide, joined or placed a letter is drawn.
DRAWN = ("<wide>", "<narrow>", "<isolated>", "<final>", "<initial>", "<medial>")
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@lru_cache(maxsize=1)
def plain_table() -> dict[str, str]:
    """Character -> what it looks like, for characters that look like others wherever they stand."""
    out: dict[str, str] = {}
    for code in [*range(0x80, 0x3200), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000), *range(0x1D100, 0x1D200), *range(0xE0000, 0xE0200)]:
        ch = chr(code)
        kind, parts = unicodedata.category(ch), unicodedata.decomposition(ch).split()
        if (kind == "Cf" and code not in VISIBLE_FORMAT) or code in INVISIBLE_OTHER:
            out[ch] = ""
        elif kind == "Zs":
            out[ch] = " "
        elif ch in HYPHENS:
            out[ch] = "-"
        elif parts and (parts[0] in DRAWN or parts[0] == "<compat>" and ("LIGATURE" in unicodedata.name(ch, "") or 0x1C4 <= code <= 0x1CC or 0x1F1 <= code <= 0x1F3)):
            whole = "".join(chr(int(p, 16)) for p in parts[1:])
            if whole.strip():
                out[ch] = whole
    changed = True
    while changed:  # a joined letter may decompose into letters that are drawn differently themselves
        changed = False
        for ch, whole in out.items():
            again = "".join(out.get(x, x) for x in whole)
            if again != whole:
                out[ch], changed = again, True
    return out


def _klass(chars) -> str:
    """A regex character class of these characters, as ranges."""
    codes, parts, i = sorted(map(ord, chars)), [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(f"{re.escape(chr(codes[i]))}-{re.escape(chr(codes[j]))}" if j > i else re.escape(chr(codes[i])))
        i = j + 1
    return "[" + "".join(parts) + "]"


LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"
GREEK_CYRILLIC = "Ͱ-ϿЀ-ԯἀ-῿"


#: What the second of two Latin twins costs, and what a spelling may cost: several of those, but no other edit.
SECOND_TWIN, BUDGET = 0.1, 0.9


@lru_cache(maxsize=1)
def readings() -> dict[str, tuple[tuple[float, str], ...]]:
    """Character -> what it may show, with the cost of each."""
    out = {ch: ((0.0, shown),) for ch, shown in plain_table().items()}
    return out | {ch: tuple((k * SECOND_TWIN, t) for k, t in enumerate(twins)) for ch, twins in TWINS.items()}


class LookalikeTrie:
    """A trie of lower-case words, as prefixes that tell whether they are words, walked by a weighted edit automaton.

    A state is a place in the token, a prefix and what has been said so far; the cheapest state goes on first. Replacing,
    dropping or adding a letter costs 1. A walk never costs more than its budget.
    """

    def __init__(self, words) -> None:
        self.nodes: dict[str, bool] = {"": False}
        for word in words:
            for k in range(1, len(word)):
                self.nodes.setdefault(word[:k], False)
            self.nodes[word] = True
        self.letters = sorted({ch for prefix in self.nodes for ch in prefix[-1:]})

    def spell(self, token: str, budget: float = BUDGET) -> str | None:
        """The cheapest word that ``token`` may show, in the case of its characters; None if there is none."""
        shows, nodes, heap, order, seen = readings(), self.nodes, [(0.0, 0, 0, "", "")], 0, set()
        while heap:
            cost, at, _, prefix, said = heapq.heappop(heap)
            if (at, prefix) in seen:
                continue
            seen.add((at, prefix))
            steps = []
            if at < len(token):
                ch = token[at]
                steps = [(extra, at + 1, prefix + shown.lower(), said + shown) for extra, shown in shows.get(ch, ((0.0, ch),))]
            elif nodes[prefix]:
                return said
            if cost + 1 <= budget:
                near = [prefix + x for x in self.letters if prefix + x in nodes]
                steps += [(1.0, at, p, said + p[-1]) for p in near]
                if at < len(token):
                    steps += [(1.0, at + 1, p, said + p[-1]) for p in near] + [(1.0, at + 1, prefix, said)]
            for extra, place, p, text in steps:
                if cost + extra <= budget and all(p[:k] in nodes for k in range(len(prefix) + 1, len(p) + 1)):
                    order += 1
                    heapq.heappush(heap, (cost + extra, place, order, p, text))
        return None


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The whole words of a public tokenizer's vocabulary (a fixed file), without those of fewer than two letters.

    A file that is missing, is no vocabulary or has no such words raises, as spellings would silently be other ones.
    """
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w in ids if w.endswith("</w>") and len(w) > 5 and w[:-4].isascii() and w[:-4].isalpha()]
    if not words:
        raise ValueError(f"no words in the vocabulary {path}")
    return words


class Canonical:
    """Writes a text in the one form; ``path`` names the vocabulary's file.

    Made by hand for another path that names no file, it goes by the table only. Operators take :func:`canonical`.
    """

    def __init__(self, path: str = VOCABULARY) -> None:
        self.path, self.plain = path, plain_table()
        self.table_only = path != VOCABULARY and not os.path.exists(path)
        accented = [chr(c) for c in [*range(0x370, 0x530), *range(0x1F00, 0x2000)] if unicodedata.normalize("NFD", chr(c))[0] in TWINS]
        self.twin = re.compile(_klass({*TWINS, *accented}))
        self.foreign = re.compile(f"[{GREEK_CYRILLIC}]")
        self.latin = re.compile(f"[{LATIN}]")
        self.word = re.compile("[^\\W\\d_]+(?:[̀-ͯ]+[^\\W\\d_]*)*")
        self.changed = re.compile(_klass(self.plain))
        in_words = {*TWINS, *accented, *(ch for ch, shown in self.plain.items() if not shown or shown.isalpha())}
        self.odd = re.compile(_klass(in_words))
        whole = {chr(c) for c in range(0x250) if chr(c).isalpha()} | {chr(c) for c in [*range(0x300, 0x530), *range(0x1E00, 0x2000)] if chr(c).isalpha() or 0x300 <= c < 0x370} | in_words
        self.letters, self.rest = frozenset(whole), re.compile(_klass(whole) + "*")
        self.cache: dict[str, str] = {}
        self.trie: LookalikeTrie | None = None
        self.by_trie = self.by_table = self.apart = 0

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        if self.odd.search(text):
            text = self._tokens(text)
        if self.changed.search(text):
            plain = self.plain
            text = self.changed.sub(lambda m: plain[m.group()], text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self._lines(text) if self.twin.search(text) else text

    def _tokens(self, text: str) -> str:
        """The words around odd characters in their form; those of look-alikes only are left for their line to decide."""
        out, done = [], 0
        for m in self.odd.finditer(text):
            at = first = m.start()
            if at < done:
                continue
            while first > done and text[first - 1] in self.letters:
                first -= 1
            last = self.rest.match(text, at).end()
            out += (text[done:first], self._token(text[first:last]))
            done = last
        return "".join([*out, text[done:]])

    def _token(self, token: str) -> str:
        if token in self.cache:
            return self.cache[token]
        if len(self.cache) > 200_000:
            self.cache.clear()
        plain = "".join([self.plain.get(ch, ch) for ch in token])
        if not self.foreign.search(plain) or self.latin.search(plain):
            plain = self._spelled(token, plain)
        self.cache[token] = plain
        return plain

    def _spelled(self, token: str, plain: str) -> str:
        """A word by the trie, or by the table if the trie doesn't hold it."""
        if self.trie is None:
            self.trie = LookalikeTrie(() if self.table_only else vocabulary(self.path))
        said, table = self.trie.spell(token), self._table(plain)
        self.by_trie += said is not None
        self.by_table += said is None
        self.apart += said is not None and said != table
        return table if said is None else said

    def _lines(self, text: str) -> str:
        out = []
        for line in text.split("\n"):
            if self.twin.search(line):
                held: list[bool] = []

                def said(m, line=line, held=held):
                    word = m.group()
                    if word.isascii() or not self._alike(word):
                        return word
                    if not held:  # only look-alikes: the line decides, and the text where the line doesn't say
                        held.append(self._reads_latin(line, text))
                    return self._spelled(word, word) if held[0] else word

                line = self.word.sub(said, line)
            out.append(line)
        return "\n".join(out)

    def _reads_latin(self, *wholes: str) -> bool:
        for whole in wholes:
            if any(ch not in TWINS for ch in self.foreign.findall(unicodedata.normalize("NFD", whole))):
                return False
            if self.latin.search(whole):
                return True
        return False

    def _alike(self, word: str) -> bool:
        """Whether every letter of a word is a look-alike."""
        return self.foreign.search(word) is not None and all(ch in TWINS or unicodedata.combining(ch) for ch in unicodedata.normalize("NFD", word))

    def _table(self, word: str) -> str:
        if not self.foreign.search(word):
            return word
        letters = unicodedata.normalize("NFD", word)
        return unicodedata.normalize("NFC", "".join(TWINS[ch][0] if ch in TWINS else ch for ch in letters))


@lru_cache(maxsize=4)
def canonical(path: str = VOCABULARY) -> Canonical:
    """One :class:`Canonical` per Python worker. It has its words at once, so a lost vocabulary fails whatever the texts hold."""
    form = Canonical(path)
    form.trie = LookalikeTrie(vocabulary(path))
    return form
