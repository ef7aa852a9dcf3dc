"""SQL for the operators that SQL can say over whole tables: an independent path to the same rows.

The one form is said as a lookup of single characters, a normalisation, and twins exchanged word by word; it knows no
vocabulary, as no word of the test tables has more than one reading.
"""

from __future__ import annotations

import unicodedata

from .forms import GREEK_CYRILLIC, LATIN, TWINS, _klass, plain_table

#: Unicode white space as a character class.
SPACE = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _twins() -> tuple[str, str]:
    """Look-alikes, also with accents, and what they become."""
    pairs = {}
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        letters = unicodedata.normalize("NFD", chr(code))
        if letters[0] in TWINS:
            whole = unicodedata.normalize("NFC", TWINS[letters[0]][0] + letters[1:])
            if len(whole) == 1:
                pairs[unicodedata.normalize("NFC", chr(code))] = whole
    return "".join(pairs), "".join(pairs.values())


def forms(table: str, key: str, text: str) -> str:
    """CTEs that end in ``forms`` (key, raw, form)."""
    plain = plain_table()
    twins, latin = _twins()
    one = {a: b for a, b in plain.items() if len(b) == 1}
    gone, several = [a for a, b in plain.items() if not b], {a: b for a, b in plain.items() if len(b) > 1}
    table_of = "MAP {" + ", ".join(f"{_text(a)}: {_text(b)}" for a, b in several.items()) + "}"
    bare = f"translate({text}, {_text(''.join(one) + ''.join(gone))}, {_text(''.join(one.values()))})"
    foreign = f"[{GREEK_CYRILLIC}]"
    other = "regexp_matches(translate({t}, " + _text(twins) + f", ''), '{foreign}')"
    return f"""
bared AS (SELECT {key}, {text} AS raw, {bare} AS t FROM {table} WHERE {text} IS NOT NULL),
shown AS (SELECT {key}, raw, nfc_normalize(CASE WHEN regexp_matches(t, {_text(_klass(several))}) THEN array_to_string(list_transform(regexp_extract_all(t, '(?s).'), lambda c: CASE WHEN c > '~' THEN coalesce({table_of}[c], c) ELSE c END), '') ELSE t END) AS t FROM bared),
lined AS (SELECT {key}, raw, t, unnest(range(len(string_split(t, chr(10))))) AS n FROM shown),
placed AS (SELECT {key}, raw, n, string_split(t, chr(10))[n + 1] AS line, {other.format(t="t")} AS t_other, regexp_matches(t, '[{LATIN}]') AS t_latin FROM lined),
judged AS (SELECT *, CASE WHEN {other.format(t="line")} THEN FALSE WHEN regexp_matches(line, '[{LATIN}]') THEN TRUE ELSE NOT t_other AND t_latin END AS latin FROM placed),
said AS (SELECT {key}, raw, n, CASE WHEN regexp_matches(line, '{foreign}') THEN array_to_string(list_transform(regexp_extract_all(line, '[\\p{{L}}\\x{{300}}-\\x{{36F}}]+|[^\\p{{L}}\\x{{300}}-\\x{{36F}}]+'), lambda w:
  CASE WHEN NOT regexp_matches(w, '{foreign}') THEN w WHEN regexp_matches(w, '[{LATIN}]') OR (latin AND NOT {other.format(t="w")}) THEN nfc_normalize(translate(w, {_text(twins)}, {_text(latin)})) ELSE w END), '') ELSE line END AS line FROM judged),
forms AS (SELECT {key}, any_value(raw) AS raw, string_agg(line, chr(10) ORDER BY n) AS form FROM said GROUP BY {key})"""


def queries() -> dict[str, str]:
    records = forms("raw_records", "record_id", "core_text")
    members = f"""WITH {records}, f AS (SELECT record_id, raw, form FROM forms WHERE regexp_matches(form, '[\\p{{L}}\\p{{N}}]'))"""
    lines = f"""WITH {records}, l AS (SELECT record_id, unnest(range(len(string_split(form, chr(10))))) AS line_no, form FROM forms),
w AS (SELECT record_id, line_no, string_split(form, chr(10))[line_no + 1] AS line FROM l),
k AS (SELECT record_id, CAST(line_no AS BIGINT) AS line_no, regexp_replace(trim(regexp_replace(lower(line), '{SPACE}+', ' ', 'g')), '\\p{{Nd}}+', '0', 'g') AS said FROM w WHERE length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 12),
i AS (SELECT DISTINCT record_id, regexp_replace(trim(c), '^0+(.)', '\\1') AS issuer FROM (SELECT record_id, unnest(metadata.filing.ciks) AS c FROM raw_records) WHERE trim(c) <> ''),
o AS (SELECT issuer, said, record_id, line_no FROM k JOIN i USING (record_id)), many AS (SELECT issuer, said FROM o GROUP BY ALL HAVING count(DISTINCT record_id) >= 8)
SELECT DISTINCT record_id, line_no FROM o JOIN many USING (issuer, said)"""
    level = f"regexp_replace(trim(regexp_replace(lower(line), '{SPACE}+', ' ', 'g')), '\\p{{Nd}}+', '0', 'g')"
    cleaned = f"""WITH {records}, l AS (SELECT record_id, unnest(range(len(string_split(form, chr(10))))) AS line_no, form FROM forms),
w AS (SELECT record_id, CAST(line_no AS BIGINT) AS line_no, string_split(form, chr(10))[line_no + 1] AS line FROM l),
k AS (SELECT record_id, line_no, {level} AS said, length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS n FROM w),
q AS (SELECT record_id, line_no, said, n >= 12 AS wide, row_number() OVER (PARTITION BY record_id ORDER BY line_no) AS s FROM k WHERE n > 0),
a AS (SELECT record_id, list(said ORDER BY s) AS arr FROM q GROUP BY record_id),
p AS (SELECT q.*, max(CASE WHEN wide THEN s END) OVER (PARTITION BY record_id ORDER BY s) AS before, min(CASE WHEN wide THEN s END) OVER (PARTITION BY record_id ORDER BY s DESC) AS after FROM q),
asked AS (SELECT record_id, line_no, 'alone' AS kind, said AS block FROM p WHERE wide UNION ALL SELECT record_id, line_no, 'before', array_to_string(arr[before:s], chr(1)) FROM p JOIN a USING (record_id) WHERE NOT wide AND before IS NOT NULL
  UNION ALL SELECT record_id, line_no, 'after', array_to_string(arr[s:after], chr(1)) FROM p JOIN a USING (record_id) WHERE NOT wide AND after IS NOT NULL),
i AS (SELECT DISTINCT record_id, regexp_replace(trim(c), '^0+(.)', '\\1') AS issuer FROM (SELECT record_id, unnest(metadata.filing.ciks) AS c FROM raw_records) WHERE trim(c) <> ''),
o AS (SELECT issuer, kind, block, record_id, line_no FROM asked JOIN i USING (record_id)), many AS (SELECT issuer, kind, block FROM o GROUP BY ALL HAVING count(DISTINCT record_id) >= 8),
gone AS (SELECT record_id, list(DISTINCT line_no) AS g FROM o JOIN many USING (issuer, kind, block) GROUP BY record_id)
SELECT r.record_id, CASE WHEN g IS NULL THEN core_text ELSE array_to_string(list_transform(list_filter(range(len(string_split(core_text, chr(10)))), lambda x: NOT list_contains(g, x)), lambda x: string_split(core_text, chr(10))[x + 1]), chr(10)) END AS core_text, CAST(coalesce(len(g), 0) AS BIGINT) AS removed
FROM raw_records r LEFT JOIN gone USING (record_id)"""
    documents, items = forms("documents", "doc_id", "text"), forms("eval_items", "item_id", "text")
    for name in ("bared", "shown", "lined", "placed", "judged", "said", "forms"):
        items = items.replace(f"\n{name} AS (", f"\ni_{name} AS (").replace(f"FROM {name} ", f"FROM i_{name} ").replace(f"FROM {name})", f"FROM i_{name})")
    words = "regexp_extract_all(lower({f}.form), '[\\p{{L}}\\p{{N}}]+')"
    leaks = f"""WITH {documents}, {items},
d AS (SELECT doc_id, {words.format(f="forms")} AS w FROM forms), e AS (SELECT item_id, {words.format(f="i_forms")} AS w FROM i_forms),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)), er AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
hits AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (run))"""
    return {
        "p4_found": lines,
        "p4_cleaned": cleaned,
        "p5_found": members + " SELECT a.record_id AS record_id_a, b.record_id AS record_id_b FROM f a JOIN f b ON a.form = b.form AND a.record_id < b.record_id AND a.raw <> b.raw",
        "p5_classes": members + ", c AS (SELECT form, min(record_id) AS class_id, count(DISTINCT raw) AS spellings FROM f GROUP BY form) SELECT record_id, class_id, CAST(spellings AS BIGINT) AS spellings FROM f JOIN c USING (form) WHERE spellings > 1",
        "p6_found": leaks + " SELECT doc_id, item_id FROM hits",
        "p6_report": leaks + " SELECT e.item_id, CAST(count(h.doc_id) AS BIGINT) AS documents FROM eval_items e LEFT JOIN hits h ON e.item_id = h.item_id GROUP BY e.item_id",
    }
