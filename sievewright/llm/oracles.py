"""SQL that gives the same rows as the queries of this subpackage, where SQL can express them.

It takes the plain way: all shared shingles, all spans, all chains. That is too slow beyond small tables.
"""

from __future__ import annotations

KEPT = r"[^\p{L}\p{Nd}{}/*+\-]+"
FIELDS = ["name", "type_line", "mana_cost", "oracle_text"]


def _canonical(x: str) -> str:
    return f"coalesce(regexp_replace(replace(replace(lower({x}), 'ς', 'σ'), 'ß', 'ss'), '{KEPT}', '', 'g'), '')"


_CARD = " || chr(31) || ".join(_canonical(f) for f in FIELDS)
_PRINTED = " || chr(31) || ".join(_canonical(f"json_extract_string(record, '$.{f}')") for f in FIELDS)
_KEYED = f"""with k as (
  select 'cards' as tab, card_no as id, {_CARD} as key from cards
  union all select 'printed_wordings', wording_id, {_PRINTED} from printed_wordings)"""


def _shingled(rows: str) -> str:
    """CTEs t (id, s, term) and n (id, n) of the rows (id, s, text)."""
    return rf"""r as ({rows}), w as (select id, s, regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+', 0) as w from r where text is not null),
t as (select distinct id, s, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as term from w where len(w) >= 3),
n as (select id, count(*) as n from t group by 1)"""


def _like(on: str) -> str:
    return f"""select a.id as x, b.id as y from t a join t b on a.term = b.term and {on} join n on n.id = a.id join n m on m.id = b.id
group by a.id, b.id, n.n, m.n having count(*) >= 0.6 * (n.n + m.n - count(*)) - 1e-9"""


_SIDE = "case when split = 'train' then 0 when split in ('validation', 'test') then 1 end"
_GROUP = "nullif(lower(trim(source_group_id)), '')"
_CARDS = r"select card_id as id, 0 as s, concat_ws(chr(10), draft.type_line, draft.oracle_text) as text from custom_cards where trim(draft.oracle_text, ' ' || chr(9) || chr(10) || chr(13)) <> ''"
_SPANS = """w as (select doc_id, s, md5(substr(text, s, 160)) as h from (select doc_id, text, unnest(range(1, length(text) - 158)) as s from documents where length(text) >= 160)),
g as (select h from w group by 1 having count(distinct doc_id) > 1), c as (select distinct w.doc_id, w.s, w.h from w join g on g.h = w.h)"""

# Characters that are not plain, and letters of two alphabets in one word.
_ODD = r"[\x{00A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{00AD}\x{FEFF}\x{034F}\x{180E}\x{FE00}-\x{FE0F}\x{0300}-\x{036F}\x{2010}\x{2011}\x{FB00}-\x{FB06}\x{FF01}-\x{FFEE}]"
_LETTERS = ["Latin", "Cyrillic", "Greek"]
_MIXED = "|".join(rf"\p{{{a}}}[\p{{N}}\p{{M}}]*\p{{{b}}}" for a in _LETTERS for b in _LETTERS if a != b)

ORACLES: dict[str, str] = {
    "p1_found": f"""{_KEYED}, f as (select tab, id, min(id) over (partition by tab, key) as first_id from k)
select tab, first_id, id as other_id from f where id > first_id""",
    "p1_copies": f"{_KEYED} select tab, min(id) as first_id, count(*) as copies from k group by tab, key",
    "p2_found": f"""with {_shingled(f"select row_id as id, {_SIDE} as s, description as text from examples where split is not null")},
e as (select row_id, {_SIDE} as s, nullif(trim(example_id), '') is not null as has, example_id, {_GROUP} as g from examples where split is not null),
p as ({_like("a.s = 0 and b.s = 1")} union select a.row_id, b.row_id from e a join e b on a.s = 0 and b.s = 1 and a.has and a.example_id = b.example_id
union select a.row_id, b.row_id from e a join e b on a.s = 0 and b.s = 1 and a.g = b.g)
select distinct least(x, y) as row_a, greatest(x, y) as row_b from p""",
    "p2_report": f"""with {_shingled(f"select row_id as id, {_SIDE} as s, description as text from examples where split is not null")},
e as (select row_id, {_SIDE} as s, nullif(trim(example_id), '') is not null as has, example_id, {_GROUP} as g from examples where split is not null),
p as (select 'description' as kind, y as id, count(*) as links from ({_like("a.s = 0 and b.s = 1")}) group by 2
union all select 'example_id', b.row_id, count(*) from e a join e b on a.s = 0 and b.s = 1 and a.has and a.example_id = b.example_id group by 2
union all select 'source_group_id', b.row_id, count(*) from e a join e b on a.s = 0 and b.s = 1 and a.g = b.g group by 2),
h as (select row_id as id, split, origin, count(*) over (partition by split, origin) as rows from examples where split in ('validation', 'test'))
select split, origin, kind, count(*) as overlapping_rows, cast(sum(links) as bigint) as links, max(rows) as rows from h join p using (id) group by 1, 2, 3""",
    "p3_found": f"with {_shingled(_CARDS)}, p as ({_like('a.id < b.id')}) select x as card_a, y as card_b from p",
    "p5_found": f"""select card_no, field_name from (select card_no, 'name' as field_name, name as x from cards union all select card_no, 'oracle_text', oracle_text from cards)
where regexp_matches(x, '{_ODD}') or regexp_matches(x, '{_MIXED}')""",
    "p6_found": f"""with recursive e as (select distinct {_GROUP} as g, nullif(lower(trim(family_id)), '') as f from examples where {_GROUP} is not null and nullif(trim(family_id), '') is not null),
n as (select distinct a.g as a, b.g as b from e a join e b on a.f = b.f), r(a, b) as (select a, b from n union select r.a, n.b from r join n on r.b = n.a)
select a as group_a, b as group_b from r where a < b""",
    # The rows that the shares ask for, the last and largest split taking the rest, and no key in two splits.
    "p6_shares": """with n as (select count(*) as n from examples), w as (select split, share as target_share, cast(round_even(n * share / sum(share) over (), 0) as bigint) as r, n, row_number() over (order by share desc, split desc) as k from split_targets, n)
select split, target_share, case k when 1 then n - sum(case k when 1 then 0 else r end) over () else r end::bigint as rows, round((case k when 1 then n - sum(case k when 1 then 0 else r end) over () else r end) / n, 6) as share, 0::bigint as leaking_keys from w""",
    "p9_found": f"with {_SPANS} select distinct a.doc_id as doc_a, b.doc_id as doc_b from c a join c b on a.h = b.h and a.doc_id < b.doc_id",
    "p9_report": f"""with {_SPANS}, d as (select distinct doc_id, s from c), l as (select doc_id, least(160, coalesce(lead(s) over (partition by doc_id order by s) - s, 160)) as fresh from d)
select l.doc_id as doc_id, max(length(t.text)) as n_chars, cast(sum(fresh) as bigint) as shared_chars, round(sum(fresh) / max(length(t.text)), 6) as share from l join documents t on t.doc_id = l.doc_id group by 1""",
}
