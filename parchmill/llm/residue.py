"""Problem 8: template gaps, filler and error pages in place of content.

1. Trusted labels. A gap is found by its form: a placeholder of a template language, a bracket that asks to be filled
   in, a masked date, a spreadsheet's error. A paragraph is filler if its words are, or if it is one word or one
   filler phrase over and over. A text is an error page if, apart from menus and copyright lines, every sentence of
   it is an error message or a demand to turn on scripts.
2. Paragraphs and whole texts without menus, as distinct texts (digits levelled), get a SimHash of word pairs. Its four
   blocks of 16 bits are the keys of four tables. A labelled text looks into each table at its own block and at all
   blocks that differ from it in one or two bits, among texts with about as many shingles (within a quarter). Texts
   that differ in at most ``hamming`` bits are candidates, and those whose sets of five-word shingles agree to
   ``similarity`` or more are linked.
3. Labels of whole paragraphs and texts spread along links until nothing new is reached: a text gets a label exactly
   if its connected component holds a trusted one. Components without a label are never built. Gaps don't spread, as
   a filled-in copy of a template is no residue.

Texts that differ in at most 11 bits are certain to meet in a table (one of four blocks has at most two of them); of
those that differ in 12 or 13, 97 and 90 in a hundred do. Tables hold SimHashes only. Texts are read again for
candidates only: each is cut into shingles once and compared in the JVM.

Defined results: null and empty texts, and texts without a letter or digit, are no cases; every copy counts; texts of
fewer than five words are compared as one shingle; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small
from ..session import cut
from .arrow import map_batches
from .forms import VOCABULARY, canonical
from .sentences import units

#: What a bracket says that asks to be filled in.
FILL_IN = "insert|enter|fill|add here|to be (?:added|completed|confirmed|determined|inserted|provided)|einf[üu]gen|erg[äa]nzen|eintragen|ins[ée]rer|compl[ée]ter|remplir|insertar|completar|rellenar|introducir|вставить|вставьте|указать|укажите|заполнить|挿入|記入|入力|插入|填写|填入|أدخل|إدراج|दर्ज करें|डालें|ใส่|กรอก|your (?:company|name|text|title)"
#: Names of fields that stand in brackets of their own.
FIELDS = "company|issuer|registrant|name|date|amount|title|address|city|state|number|year|quarter|period|ticker|value|score|percent|percentage|price|currency|client|customer|headline|summary|signature block"
GAP = re.compile(
    "|".join([
        r"\{\{[^{}\n]*\}\}", r"\{%[^%\n]*%\}", r"<%[^%\n]*%>", r"\$\{[^{}\n]+\}", r"%%[A-Za-z_][\w .-]*%%", r"@@[A-Za-z_][\w.-]*@@", r"\[\[[A-Za-z_][^\[\]\n]*\]\]", r"(?<![\w])__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__(?!\w)",
        r"(?<![\w{])\{(?:\d|[A-Za-z_]\w*(?:[._]\w+)*)\}(?!\})", r"%\([A-Za-z_]\w*\)[sdf]", r"(?<!\S)%[sd](?!\w)",
        r"#(?:REF!|VALUE!|NAME\?|DIV/0!|N/A|NULL!|NUM!)", r"\[object Object\]",
        r"\[\s*(?:TBD|TBC|TBA|TODO|TK|N\.?N\.?|●+|•+|…+|\.{3,}|\?+|\*{2,}|_+|X{2,}(?:[.,/]X+)*)\s*\]", rf"\[\s*(?:the )?(?:{FIELDS})(?: (?:of )?(?:the )?(?:{FIELDS}))*\s*\]",
        rf"<\s*(?:{FIELDS})(?:[ _](?:{FIELDS}))*\s*>",
        r"(?<![A-Za-z])XX?[/.-]XX?[/.-](?:XXXX|20XX|XX)(?![A-Za-z])", r"(?<![A-Za-z])(?:DD[/.-]MM|MM[/.-]DD)[/.-]YY(?:YY)?(?![A-Za-z])", r"(?<!\w)(?:19|20)XX(?!\w)", r"[$€£]\s?(?:X{1,3}(?:[.,]X+)*|_{2,})(?!\w)", r"(?<!\w)X{2,}(?:[.,]X+)? ?%",
    ]), re.I,
)
_bracket = re.compile(r"\[([^\[\]\n]+)\]|<([^<>\n]+)>")
_asks = re.compile(FILL_IN, re.I)
#: In a long bracket the asking word is a word of its own, and markup with attributes asks for nothing.
_asks_long = re.compile(rf"(?<![A-Za-z])(?:{FILL_IN})(?!ed\b|ing\b|ions?\b|s\b| into\b)", re.I)
_plain_words = re.compile(r"\s*[^\W\d_](?![^=]*=)")
_gap_sign = re.compile(r"[\[{<#@%_Xx$€£MmDd](?:(?<=[\[{<#])|(?<=@)@|(?<=%)[%(sd]|(?<=_)_|(?<=[Xx])[Xx]|(?<=[Xx])[/.-][Xx]|(?<=[$€£])\s?[Xx_]|(?<=[MmDd])[MmDd][/.-])")
#: What masked figures and dates have without any of the signs above.
_mask_sign = re.compile(r"[Xx][Xx/.-]|[Mm][Mm][/.-]|[Dd][Dd][/.-]")

#: Words of the usual Latin filler.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
#: Those of them that no other language shares.
LATIN_ONLY = frozenset("lorem ipsum dolor amet consectetur consectetuer adipiscing elit eiusmod tempor incididunt dolore aliqua veniam nostrud exercitation ullamco laboris aliquip commodo consequat reprehenderit voluptate cillum fugiat pariatur excepteur occaecat cupidatat proident deserunt mollit laborum".split())
#: Phrases that fill a page until its text is there.
FILLER = re.compile(r"(?:sample|dummy|filler|placeholder|example|test|blind|your|body) (?:text|paragraph|copy|content)|text goes here|replace (?:before|this)|platzhalter|blindtext|mustertext|texte? (?:de remplissage|fictif|factice|à remplacer)|texto (?:de relleno|de ejemplo|de prueba|simulado)|текст[- ]заполнитель|пример текста|рыба[- ]?текст|замените|ダミー|サンプルテキスト|占位|示例文[本字]|此处.{0,6}文[本字]|نص (?:تجريبي|بديل|عينة)|नमूना पाठ|ข้อความตัวอย่าง", re.I)
#: One of these is part of every text, in lower case, that FILLER finds something in.
_filler_signs = ("text", "paragraph", "copy", "content", "replace", "platzhalter", "текст", "замените", "ダミー", "サンプルテキスト", "占位", "示例文", "此处", "نص ", "नमूना", "ข้อความ")
#: How a sentence of any length starts that says of itself that it is filler.
SAYS_SO = re.compile(
    r"\W*(?:(?:note|nb|hinweis|nota|remarque)\W+)?(?:"
    rf"(?:this|these|here|the (?:following|above)|das|dies(?:er|es)?|hier|ceci|ce|cette|voici|ici|est[aeo]|aqu[íi]|это(?:т)?|здесь|هذا|هنا|यह|यहाँ)\s+(?:[^\W\d_]+\s+){{0,3}}?(?:{FILLER.pattern})"
    rf"|(?:これは|ここ[にでは]*|この|以下は?|本[文段]|这[是里段]|這[是裡段]|此处|此處|以下是?|นี่คือ|ที่นี่)[^。！？\n]{{0,8}}?(?:{FILLER.pattern})"
    r"|(?:please\s+)?replace (?:before|this)|(?:your |some |sample |dummy )?text goes here|bitte[^.!?]{0,20}platzhalter|(?:пожалуйста,? )?замените|此处.{0,6}文[本字]"
    r")", re.I,
)
_mash = re.compile(r"(?:asdf|qwer|zxcv|jkl|hjkl|fdsa|wasd)[a-z]*|x{3,}|z{3,}|(?:bla|blah|foo|bar|baz|test|text|tbd|todo|dummy)")
#: Sentences of error pages, each from its start.
ERROR = re.compile(
    "(?:" + "|".join([
        r"(?:https? )?(?:error|fehler|erreur|error|ошибка|エラー|错误|خطأ|त्रुटि)\s*(?:code|n[o°º]\.?)?\s*[45]\d\d\b", r"[45]\d\d\s*[-:.–—|]?\s*(?:not found|forbidden|bad gateway|internal server error|service (?:temporarily )?unavailable|unauthorized|gateway time-?out|error|page|fehler|erreur|access)",
        r"(?:the |this )?(?:requested )?(?:page|document|resource|file|url|site|address|viewer|server|service|application)\b[^.!?]{0,60}\b(?:not (?:be )?(?:found|located|available|exist|work|load)|could not be|cannot be|no longer (?:available|exists)|does not (?:exist|work)|has been (?:removed|moved)|unavailable|timed out)",
        r"(?:this|the) (?:page|viewer|site|app|application|document|filing|content)[^.!?]{0,60}(?:requires?|needs?|without|works? (?:only|best) with)[^.!?]{0,30}(?:java ?script|scripts?|scripting|cookies)",
        r"(?:you )?(?:need to|must|have to|please|kindly)[^.!?]{0,40}(?:enable|turn (?:it |them )?on|activate|allow|switch (?:it |them )?on)[^.!?]{0,40}", r"(?:please )?(?:enable|turn on|activate|allow)\b[^.!?]{0,20}(?:java ?script|scripts?|scripting|cookies|it in your browser)", r"java ?script (?:is|must|has|needs|was|appears|seems)[^.!?]{0,30}(?:required|disabled|enabled|turned|off|needed|blocked)", r"(?:your|this) browser[^.!?]{0,40}(?:does not|doesn't|has|is)[^.!?]{0,40}(?:support|disabled|script|outdated|block)", r"checking (?:your|the|if)[^.!?]{0,30}(?:browser|connection|secure)", r"(?:please )?(?:verify|confirm|prove)[^.!?]{0,20} (?:human|robot)",
        r"(?:internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|not found|forbidden|unauthorized|access (?:is )?(?:denied|forbidden)|permission denied|request (?:timed out|blocked)|too many requests|an? (?:unexpected|internal|unknown)? ?error (?:has )?occurred|something went wrong|unhandled exception|fatal error|connection (?:refused|reset|timed out)|database (?:error|connection)|page not found|file not found|session (?:has )?(?:expired|timed out)|stack trace|traceback)\b",
        r"your (?:session|request|access|connection|ip)[^.!?]{0,50}(?:expired|exceeded|denied|blocked|timed out|limit)", r"(?:please )?(?:sign|log) ?in (?:again|to continue)", r"(?:please )?(?:try again|retry|reload|refresh|return to the home ?page|go back|contact the (?:site |system )?administrator|use the search)\b", r"reference\s*(?:#|no|id|code)", r"(?:we are|we're|the site is|this site is)[^.!?]{0,30}(?:maintenance|unavailable|down)",
        r"(?:bitte )?[^.!?]{0,12}(?:aktivieren sie|schalten sie)[^.!?]{0,40}(?:java ?script|skripte?|cookies|ein)", r"(?:java ?script|cookies?)[^.!?]{0,40}(?:aktiviert|erforderlich|deaktiviert|benötigt)", r"(?:die |diese )?(?:seite|datei|dokument)[^.!?]{0,40}(?:nicht (?:gefunden|verfügbar|vorhanden)|existiert nicht)", r"zugriff (?:verweigert|nicht)", r"interner (?:server)?fehler", r"bitte (?:prüfen|überprüfen|versuchen|laden|melden) sie", r"(?:der )?(?:server|dienst)[^.!?]{0,40}nicht (?:erreichbar|verfügbar)", r"(?:ihre )?sitzung[^.!?]{0,20}abgelaufen",
        r"(?:veuillez|merci de|vous devez)[^.!?]{0,20}(?:activer|réessayer|recharger|vérifier|vous (?:re)?connecter|autoriser)", r"(?:java ?script|les scripts|les cookies)[^.!?]{0,40}(?:activé|désactivé|requis|nécessaire)", r"(?:la |cette )?page[^.!?]{0,40}(?:introuvable|n['’]existe|n['’]est (?:plus|pas) disponible)", r"erreur (?:interne|du serveur|inattendue)", r"accès (?:refusé|interdit)", r"service (?:temporairement )?indisponible", r"(?:votre )?session (?:a )?expiré",
        r"(?:la )?página[^.!?]{0,30}(?:no (?:se ha )?encontrada?|no existe|no (?:está )?disponible)", r"el (?:archivo|documento|recurso)[^.!?]{0,40}(?:movido|eliminado|no (?:existe|se))", r"(?:por favor,? )?(?:active|habilite|debe (?:activar|habilitar)|es necesario (?:activar|habilitar))[^.!?]{0,40}(?:java ?script|scripts|cookies)", r"(?:se requiere|java ?script)[^.!?]{0,40}(?:java ?script|habilitad|activad|necesari)", r"acceso denegado", r"error (?:interno|del servidor|inesperado)", r"servicio (?:temporalmente )?no disponible", r"(?:su )?sesión[^.!?]{0,20}(?:caducado|expirado)", r"(?:inténtelo|vuelva|intente)[^.!?]{0,30}(?:de nuevo|más tarde|intentarlo)",
        r"(?:пожалуйста,? )?(?:включите|разрешите)[^.!?]{0,40}(?:java ?script|скрипт|cookie)", r"(?:для [^.!?]{0,60})?(?:необходимо|нужно|требуется)[^.!?]{0,30}(?:включить|java ?script)", r"страница[^.!?]{0,30}(?:не найдена|не существует|недоступна|удалена)", r"(?:внутренняя )?ошибка (?:сервера|доступа|\d)", r"доступ (?:запрещ|закрыт)", r"(?:сервис|сервер)[^.!?]{0,40}(?:недоступ|не отвечает)", r"(?:попробуйте|повторите)[^.!?]{0,40}(?:позже|снова|попытку)", r"(?:ваша )?сессия[^.!?]{0,20}истекла",
        r"[^。！？]{0,30}java ?script[^。！？]{0,12}(?:有効|オン|必要|無効)", r"[^。！？]{0,20}(?:ページ|ファイル|文書)[^。！？]{0,12}(?:見つかりません|存在しません|表示できません)", r"(?:内部)?サーバー?(?:内部)?エラー", r"アクセス[^。！？]{0,10}(?:拒否|禁止|できません)", r"[^。！？]{0,20}(?:しばらく|後で|もう一度)[^。！？]{0,20}(?:ください|お試し)", r"セッション[^。！？]{0,10}(?:切れ|期限)",
        r"[^。！？]{0,20}(?:启用|开启|打开|允许|啟用)[^。！？]{0,12}(?:java ?script|脚本|腳本|cookie)", r"[^。！？]{0,16}(?:页面|網頁|网页|文件|頁面)[^。！？]{0,12}(?:不存在|未找到|找不到|无法|已被)", r"(?:内部)?(?:服务器|伺服器)(?:内部)?(?:错误|錯誤|无响应)", r"(?:访问|存取|拒绝)[^。！？]{0,8}(?:拒绝|被拒|访问|受限)", r"(?:请|請)[^。！？]{0,16}(?:重试|稍后|刷新|重新登录)",
        r"[^.!؟]{0,20}(?:تفعيل|تمكين|تشغيل)[^.!؟]{0,30}", r"[^.!؟]{0,10}الصفحة[^.!؟]{0,30}(?:غير موجودة|غير متاحة|لم يتم)", r"خطأ[^.!؟]{0,20}(?:الخادم|داخلي)", r"تم رفض الوصول|الوصول مرفوض", r"(?:يرجى|الرجاء)[^.!؟]{0,30}(?:المحاولة|تحديث|تسجيل)",
        r"[^।!?]{0,40}(?:जावास्क्रिप्ट|java ?script)[^।!?]{0,30}(?:सक्षम|चालू|आवश्यक)", r"[^।!?]{0,20}(?:पृष्ठ|पेज)[^।!?]{0,20}(?:नहीं मिला|उपलब्ध नहीं|मौजूद नहीं)", r"[^।!?]{0,10}सर्वर[^।!?]{0,20}(?:त्रुटि|उपलब्ध)", r"कृपया[^।!?]{0,30}(?:पुनः|दोबारा|फिर)",
        r"[^\n]{0,30}(?:เปิดใช้งาน|เปิดใช้)[^\n]{0,20}(?:java ?script|สคริปต์|จาวา)", r"[^\n]{0,20}ไม่พบหน้า", r"[^\n]{0,20}(?:เซิร์ฟเวอร์|ระบบ)[^\n]{0,10}(?:ผิดพลาด|ขัดข้อง)", r"(?:กรุณา|โปรด)[^\n]{0,20}(?:ลองใหม่|เปิดใช้|เข้าสู่ระบบ)",
    ]) + ")", re.I,
)
_frame = re.compile(r"\s*(?:©|\(c\)|copyright\b)|[^.!?。！？।؟|»›·]*[|»›·][^.!?。！？।؟]*$|\s*(?:[^\s.!?。！？।؟]+\s+){0,3}[^\s.!?。！？।؟]+\s*$", re.I)
#: Chinese and Japanese have no spaces: each of their characters is a word.
_HAN_KANA = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_han_kana = re.compile(f"[{_HAN_KANA}]")
_all_han_kana = re.compile(f"[{_HAN_KANA}]+").fullmatch
_cut_words = re.compile(rf"[{_HAN_KANA}]|[^\W_{_HAN_KANA}]+")
_words = re.compile(r"\d+(?:[.,]\d+)+|[^\W_]+")
_figures = re.compile(r"\d+")
_host = re.compile(r"\b(?:https?://)?(?:www\.)[\w.-]+|\bhttps?://\S+", re.I)
TABLES = 4
#: Lists of candidates of at most this many rows are broadcast, longer ones go through a shuffle.
BROADCAST_ROWS = 100_000
#: Probes of at most this many SimHashes are broadcast (1,644 small rows each), so that later steps shuffle no table.
BROADCAST_PROBES = 100
_STEP = math.log(1.25)


def has_gap(text: str) -> bool:
    """Whether a text in the one form has a gap of a template."""
    return (any(c in text for c in "[{<#@%_$€£") or _mask_sign.search(text) is not None) and _gap_sign.search(text) is not None and (GAP.search(text) is not None or any(map(_asks_to_fill, _bracket.finditer(text))))


def _asks_to_fill(bracket: re.Match) -> bool:
    square, angle = bracket.groups()
    said, near = (square, 60) if square else (angle, 40)
    if len(said) <= near:
        return _asks.search(said) is not None
    if any(m.start() <= near and len(said) - m.end() <= near for m in _asks.finditer(said)):
        return True
    return _asks_long.search(said) is not None and (square is not None or _plain_words.match(said) is not None)


def _cut(text: str) -> list[str]:
    """The words of a text, with each Chinese or Japanese character as one."""
    words = _words.findall(text)
    if text.isascii() or not _han_kana.search(text):
        return words
    out: list[str] = []
    for w in words:
        if w.isascii():
            out.append(w)
        elif _all_han_kana(w):
            out.extend(w)
        else:
            out += _cut_words.findall(w)
    return out


def _is_latin(words: list[str]) -> bool:
    n = len(words)
    return n >= 3 and not LATIN_ONLY.isdisjoint(words) and sum(w in LATIN for w in words) >= 0.8 * n and sum(w in LATIN_ONLY for w in words) >= max(2, 0.25 * n)


def _names_filler(low: str) -> bool:
    for sign in _filler_signs:
        at = low.find(sign)
        while at >= 0:  # a match holds a sign and has fewer than 40 characters
            if FILLER.search(low, max(0, at - 40), at + 40):
                return True
            at = low.find(sign, at + 1)
    return False


def may_be_filler(low: str, words: list[str]) -> bool:
    """Whether a lower-case text holds any word or sign that filler in words needs; paragraphs of other texts needn't be searched."""
    return not LATIN_ONLY.isdisjoint(words) or any(sign in low for sign in _filler_signs)


def is_filler(paragraph: str, words: list[str], suspect: bool = True) -> bool:
    """Whether a paragraph is nothing but filler; ``words`` are its words in lower case, ``suspect`` is :func:`may_be_filler`."""
    n = len(words)
    if n >= 3 and _mash.fullmatch(words[0]) and all(_mash.fullmatch(w) for w in words):
        return True
    if n >= 4 and words.count(words[0]) == n:
        return True
    if not suspect:
        return False
    if _is_latin(words):
        return True
    low = paragraph.lower()
    if not _names_filler(low):
        return False
    again = len(set(words)) <= n / 2  # the same over and over
    for said in {low[a:b] for a, b in units(low)}:
        if not _names_filler(said):
            if not _is_latin(_cut(said)):
                return False
        elif not again and len(set(_cut(said))) > 8 and not SAYS_SO.match(said):
            return False
    return True


def is_error_page(body: str) -> bool:
    """Whether every sentence of a text is one of an error page."""
    if not ERROR.match(body):
        return False
    return all(ERROR.match(body, a) or (b - a < 4) for a, b in units(body))


def body_lines(text: str) -> list[str]:
    """The lines of a text, stripped, without menus, titles and copyright lines if anything else is left."""
    lines = [s for line in text.split("\n") if (s := line.strip()) and _words.search(s)]
    if len(lines) > 1:
        return [line for line in lines if not _frame.match(line)] or lines
    return lines


class _Hashes(dict):
    """Word -> 64-bit hash, with figures levelled; forgotten between batches when there are many."""

    def __missing__(self, word: str) -> int:
        level = "0" if word[0].isdigit() and not word.isalnum() else _figures.sub("0", word)
        h = self[word] = int.from_bytes(hashlib.blake2b(level.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_hashes = _Hashes()


_ODD, _LANES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x0101010101010101)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each stretch have each of the 64 bits; a stretch reaches to the next start.

    Bits are added up eight to a word, in steps of at most 255 hashes, so that no count leaves its byte.
    """
    sizes = np.diff(np.append(starts, len(hashes)))
    steps = -(-sizes // 255)
    first = np.cumsum(steps) - steps
    fine = np.repeat(starts, steps) + 255 * (np.arange(int(steps.sum())) - np.repeat(first, steps))
    out = np.empty((len(fine), 8, 8), np.int32)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, fine)
        out[:, :, k] = sums.view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(out.reshape(-1, 64), first, axis=0)


def distinct_in(stretch: np.ndarray, hashes: np.ndarray, count: int) -> np.ndarray:
    """How many distinct hashes each stretch has (its number goes with each hash)."""
    bits = max(1, int(count).bit_length())
    keys = np.sort((stretch.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits)))
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
    return np.bincount((keys[new] >> np.uint64(64 - bits)).astype(np.int64), minlength=count)


def features(words: list[str], starts: list[int], lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, sim, size) of each stretch of ``words``, given by its start and its length (at least 1).

    ``unit`` tells stretches of different words apart, ``sim`` is the SimHash of the pairs of neighbouring words (of the
    word, if it is one), ``size`` the logarithmic step of the number of distinct five-word shingles.
    """
    lengths, n = np.array(lengths), len(starts)
    first = np.cumsum(lengths) - lengths
    of, place = np.repeat(np.arange(n), lengths), np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    one = _hashes.of(words)[np.repeat(starts, lengths) + place]
    with np.errstate(over="ignore"):
        unit = np.add.reduceat(_mix(one + place.astype(np.uint64) * _ODD), first)
        two = _mix(np.roll(one, 1) * _ODD ^ one)
        two[first] = np.where(lengths == 1, one[first], np.uint64(0))  # a first word has no pair
        five = one
        for k in range(1, 5):
            five = _mix(five[: len(one) - k] * _ODD + one[k:])
    sim = np.packbits(2 * bit_sums(two, first) > np.maximum(lengths - 1, 1)[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
    whole = place[: len(five)] <= (lengths - 5)[of[: len(five)]]
    counts = np.maximum(distinct_in(of[: len(five)][whole], five[whole], n), 1)
    return unit.view(np.int64), sim, np.floor(np.log(counts) / _STEP + 1e-9).astype(np.int32)


def words_of_lines(lines: list[str]) -> list[list[str]]:
    """The words of lower-case lines that are compared, hosts levelled; figures are levelled when words are hashed."""
    text = "\n".join(lines)
    if "www." in text or "http" in text:
        lines = _host.sub("host", text).split("\n")
    return [_cut(line) for line in lines]


def words_of(text: str) -> list[str]:
    """The compared words of a text of one line."""
    return words_of_lines([text.lower()])[0]


def document_units(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(id, gap, part, unit, label, sim, size): per document its paragraphs (part >= 0) and its whole body (part -1).

    ``label`` is the trusted label: "error" or "filler". A document of one paragraph has that as its body; a document
    with a gap has one row more, without a unit. ``size`` is the logarithmic step of the number of distinct shingles.
    """

    def make():
        form_of = canonical(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            gaps: list[int] = []
            rows, numbers, labels, words, starts, lengths = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                shown = form_of(t)
                if has_gap(shown):
                    gaps.append(i)
                lines = body_lines(shown)
                if not lines:
                    continue
                low = [line.lower() for line in lines]
                parts_words = words_of_lines(low)  # every line has a word
                whole = [w for p in parts_words for w in p]
                body = " ".join(lines)
                suspect = may_be_filler(" ".join(low), whole)
                at = len(words)
                words += whole
                rows.append(i), numbers.append(-1), starts.append(at), lengths.append(len(whole))
                labels.append("error" if is_error_page(body) else "filler" if is_filler(body, whole, suspect) else None)
                if len(lines) > 1:
                    for n, w in enumerate(parts_words):
                        filler = is_filler(lines[n], w, suspect)
                        if filler or len(w) >= 3:
                            rows.append(i), numbers.append(n), labels.append("filler" if filler else None), starts.append(at), lengths.append(len(w))
                        at += len(w)
            unit, sim, size = features(words, starts, lengths) if words else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))
            g, n = len(gaps), len(rows)

            def column(values, kind):
                return pa.concat_arrays([pa.nulls(g, kind), pa.array(values, kind)])

            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(gaps + rows, pa.int64())), pa.array([True] * g + [False] * n, pa.bool_()), pa.array([-1] * g + numbers, pa.int32()), column(unit, pa.int64()), column(labels, pa.string()), column(sim, pa.int64()), column(size, pa.int32())],
                names=["id", "gap", "part", "unit", "label", "sim", "size"],
            )

        return step

    source = df.select(F.col(key).alias("id"), F.col(text).alias("__text")).filter(F.col("__text").isNotNull() & (F.col("__text") != ""))
    return map_batches(source, make, f"id {dict(source.dtypes)['id']}, gap boolean, part int, unit long, label string, sim long, size int")


#: All ways to turn at most two of a block's bits.
_TURNS = [0, *(1 << a for a in range(16)), *((1 << a) | (1 << b) for a in range(16) for b in range(a))]


def _block(sim: str, n: str):
    return F.expr(f"cast(shiftrightunsigned({sim}, 16 * {n}) & 65535 as int)")


def sim_tables(points: DataFrame) -> DataFrame:
    """(key, step, sb): each SimHash under its four blocks. ``points`` has (sim, size)."""
    rows = points.withColumn("n", F.explode(F.array(*map(F.lit, range(TABLES)))))
    return rows.select((_block("sim", "n") + F.col("n") * 65536).alias("key"), F.col("size").alias("step"), F.col("sim").alias("sb"))


def sim_probes(points: DataFrame) -> DataFrame:
    """(key, step, sa, za): each SimHash under all blocks and lengths where its neighbours may stand."""
    rows = points.withColumn("n", F.explode(F.array(*map(F.lit, range(TABLES))))).withColumn("turn", F.explode(F.array(*map(F.lit, _TURNS))))
    key = _block("sim", "n").bitwiseXOR(F.col("turn")) + F.col("n") * 65536
    return rows.select(key.alias("key"), F.explode(F.array(*[F.col("size") + k for k in (-1, 0, 1)])).alias("step"), F.col("sim").alias("sa"), F.col("size").alias("za"))


def sim_neighbours(frontier: DataFrame, tables: DataFrame, hamming: int) -> DataFrame:
    """(sa, za, sb, step): SimHashes of the tables near those of the frontier, each pair once."""
    probes = sim_probes(frontier.select("sim", "size").distinct())
    # the planner takes exploded rows for few, so that only a count may choose a broadcast
    met = (F.broadcast(probes) if frontier.count() <= BROADCAST_PROBES else probes.hint("merge")).join(tables, ["key", "step"])
    return met.filter(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= hamming).select("sa", "za", "sb", "step").distinct()


def shingles(words: list[str], n: int = 5) -> np.ndarray:
    """The distinct hashed runs of ``n`` words; of fewer words the one of all."""
    one = run = _hashes.of(words)
    with np.errstate(over="ignore"):
        for k in range(1, min(n, len(words))):
            run = _mix(run[: len(one) - k] * _ODD + one[k:])
    return np.unique(run).view(np.int64)


def shingle_hashes(df: DataFrame, wanted: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(id, part, shingles): the hashed five-word shingles of the wanted (id, part) places; each text is read once."""
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("__t"))
    places = wanted.groupBy("id").agg(F.collect_set("part").alias("parts"))  # at most a text's paragraphs
    few = small(places, BROADCAST_ROWS)
    rows = texts.join(few, "id").select("id", "parts", "__t")

    def make():
        form_of = canonical(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, numbers, out = [], [], []
            for i, (parts, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                lines = words_of_lines([line.lower() for line in body_lines(form_of(t))])
                for part in parts:
                    words = [w for line in lines for w in line] if part < 0 else lines[part]
                    at.append(i), numbers.append(part)
                    out.append(shingles(words))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=["id", "part", "shingles"])

        return step

    return map_batches(rows, make, f"id {dict(rows.dtypes)['id']}, part int, shingles array<long>")


def linked(pairs: DataFrame, df: DataFrame, key: str, text: str, similarity: float, path: str) -> DataFrame:
    """Of the pairs (ua, ia, pa, label, ub, ib, pb) those whose sets of five-word shingles are similar enough."""
    ends = [pairs.select(F.col(f"i{s}").alias("id"), F.col(f"p{s}").alias("part")) for s in "ab"]
    prints = cut(shingle_hashes(df, ends[0].union(ends[1]).distinct(), key, text, path), "shingles")
    both = pairs
    for s in "ab":
        both = both.join(prints.select(F.col("id").alias(f"i{s}"), F.col("part").alias(f"p{s}"), F.col("shingles").alias(f"x{s}")), [f"i{s}", f"p{s}"])
    return both.filter(F.size(F.array_intersect("xa", "xb")) >= similarity * F.size(F.array_union("xa", "xb"))).select("ua", "label", "ub")


def residue_labels(df: DataFrame, key: str = "doc_id", text: str = "text", hamming: int = 13, similarity: float = 0.8, path: str = VOCABULARY) -> DataFrame:
    """(key, label, origin): the documents to exclude, with "gap", "error" or "filler"; one row per document and label.

    ``origin`` is "rule" where the document itself has the trusted label, "link" where its component brings it.
    """
    found = cut(document_units(df, key, text, path), "units")
    named = found.filter("unit IS NOT NULL")

    def texts_of(units: DataFrame) -> DataFrame:  # one row per distinct text; copies fold before the shuffle
        return units.groupBy("unit").agg(F.min("sim").alias("sim"), F.min("size").alias("size"), F.min(F.struct("id", "part")).alias("at"), F.max("label").alias("label")).select("unit", "sim", "size", "at.id", "at.part", "label")

    frontier = reached = cut(texts_of(named.filter("label IS NOT NULL")), "reached")
    unlabelled = named.filter("label IS NULL")
    tables = sim_tables(cut(unlabelled.select("sim", "size").distinct(), "points"))
    while True:  # one step along the links of the labelled components; ends when a step reaches nothing new
        near = cut(sim_neighbours(frontier, tables, hamming), "near")
        if near.isEmpty():
            break
        ends = small(near.select(F.col("sb").alias("sim"), F.col("step").alias("size")).distinct(), BROADCAST_ROWS)
        met = texts_of(unlabelled.join(ends, ["sim", "size"])).join(reached.select("unit"), "unit", "left_anti")
        pairs = near.join(frontier.select(F.col("sim").alias("sa"), F.col("size").alias("za"), F.col("unit").alias("ua"), F.col("id").alias("ia"), F.col("part").alias("pa"), "label"), ["sa", "za"])
        pairs = cut(pairs.join(met.select(F.col("sim").alias("sb"), F.col("size").alias("step"), F.col("unit").alias("ub"), F.col("id").alias("ib"), F.col("part").alias("pb")), ["sb", "step"]).drop("sa", "za", "sb", "step"), "pairs")
        if pairs.isEmpty():
            break
        new = linked(pairs, df, key, text, similarity, path).groupBy(F.col("ub").alias("unit")).agg(F.max("label").alias("label"))
        frontier = cut(met.drop("label").join(new, "unit").select(reached.columns), "reached")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    whole = named.select("id", "part", "unit", F.col("label").alias("own")).join(small(reached.select("unit", "label"), BROADCAST_ROWS), "unit").filter("part < 0 OR label = 'filler'")
    spread = whole.groupBy("id", "label").agg(F.when(F.bool_or(F.col("own").isNotNull()), "rule").otherwise("link").alias("origin"))
    gaps = found.filter("gap").select("id", F.lit("gap").alias("label"), F.lit("rule").alias("origin"))
    return gaps.unionByName(spread).withColumnRenamed("id", key)


def residue(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key): the documents to exclude."""
    return residue_labels(df, key, text, **options).select(key).distinct()


def without_residue(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` without the documents to exclude."""
    return df.join(residue(df, key, text, **options), key, "left_anti")
