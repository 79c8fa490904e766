"""SQL (DuckDB) that gives the same rows as the queries it can express."""

from __future__ import annotations

from quern.llm.chat import CONTROLS, HARD
from quern.llm.decontaminate import NAME, NUM, UNIT, UNITS, Matching
from quern.llm.url_rules import LOWER, RULES, UPPER, Mining


def chat_sql() -> str:
    """Digests by string_agg; a rendered turn is its escaped text between its marks."""
    conflict = "|".join([r"\\", *(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)])
    escaped = f"regexp_replace({{}}, '({conflict})', '\\\\\\1', 'g')"
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, t, r, '{HARD}' from (values (0, 'user'), (1, 'assistant')) x(t, r)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({escaped.format('text')}) + case role when 'user' then {len('[INST][/INST]')} when 'system' then {len('<<SYS>><</SYS>>')} when 'assistant' then {len('</s>')}
    else {len('<<ROLE>><</ROLE>></s>')} + length({escaped.format('role')}) end)::bigint as formatted_chars
from c group by conv_id"""


def leak_sql(how: Matching = Matching()) -> str:
    """Windows joined by their words' templates, then one-to-one slots and coverage."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    kind = f"""case when w >= 'a' and w < '{{' then case when w in ({units}) then '{UNIT}' end
      when w >= 'A' and w < 'a' then '{NAME}' when w >= '0' and w < ':' then '{NUM}' when lower(w[1]) <> w[1] then '{NAME}' end"""
    # points and commas before a digit are parts of words: hidden while the rest is split
    split = r"""list_transform(string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '\.([0-9])', chr(1) || '\1', 'g'), ',([0-9])', chr(2) || '\1', 'g'),
      '[\t\n\x0B\f\r !-/:-@\[-`{-~]+'), lambda w: replace(replace(w, chr(1), '.'), chr(2), ','))"""
    size = how.window
    return f"""
with item as (
  select item_id, text, w as words, len(w) as item_words from (select distinct item_id, text, list_filter({split}, lambda w: w <> '') as w from benchmark) where len(w) > 0
), doc as (select distinct doc_id, text, {split} as words from documents),
part as (
  select *, least(item_words, {size}) as n, unnest(range(1, item_words - least(item_words, {size}) + 2)) as i from item
), slice as (
  select item_id, text, item_words, n, i, words[i:i + n - 1] as s, list_transform(words[i:i + n - 1], lambda w: {kind}) as k from part
), lit as (
  select *, len(list_filter(k, lambda x: x is null)) >= least({how.literals}, n) as rich from slice
), item_kind as (
  select item_id, text, count(distinct p) as held from (select item_id, text, unnest(range(i, i + n)) as p from lit where rich) group by 1, 2
), sought as (
  select lit.*, coalesce(held, 0) >= {how.share} * item_words as by_template from lit left join item_kind using (item_id, text)
), sizes as (select distinct n from sought),
wins as (
  select doc_id, text as doc_text, n, i as p, words[i:i + n - 1] as d from (select doc.*, n, unnest(range(1, len(words) - n + 2)) as i from doc, sizes where len(words) >= n)
), keyed as (
  select *, list_transform(d, lambda w: coalesce({kind}, w)) as t, list_transform(d, lambda w: lower(w)) as l from wins
), hit as (
  select doc_id, doc_text, item_id, sought.text as item_text, item_words, i, p - i as shift, sought.n, s, d, k from keyed join sought
    on keyed.n = sought.n and by_template and rich and t = list_transform(s, lambda w: coalesce({kind}, w))
  union all
  select doc_id, doc_text, item_id, sought.text, item_words, i, p - i, sought.n, s, d, k from keyed join sought
    on keyed.n = sought.n and not by_template and l = list_transform(s, lambda w: lower(w))
), slot as (
  select distinct doc_id, doc_text, item_id, item_text, shift, s[j] as a, d[j] as b from (select *, unnest(range(1, n + 1)) as j from hit) where k[j] is not null
), fit as (
  select doc_id, doc_text, item_id, item_text, shift, count(*) as slots, count(*) filter (a <> b) as exchanged, count(distinct a) = count(*) and count(distinct b) = count(*) as ok from slot group by all
), good as (
  select hit.*, coalesce(slots, 0) as slots, coalesce(exchanged, 0) as exchanged from hit left join fit
    on hit.doc_id is not distinct from fit.doc_id and hit.doc_text is not distinct from fit.doc_text and hit.item_id is not distinct from fit.item_id and hit.item_text = fit.item_text and hit.shift = fit.shift
  where coalesce(ok, true)
), total as (
  select doc_id, doc_text, item_id, item_text, item_words, count(distinct c) as covered, max(slots) as slots, max(exchanged) as exchanged
  from (select *, unnest(range(i, i + n)) as c from good) group by 1, 2, 3, 4, 5
)
select doc_id, item_id, covered::int as covered, item_words::int as item_words, covered / item_words as coverage, slots::int as slots, exchanged::int as exchanged
from total where covered / item_words >= {how.share}"""


def url_sql(how: Mining = Mining()) -> str:
    """Rules by counting all sets of up to three tokens; a URL's confidence is that of its best rule."""
    if how.tokens != 3:
        raise ValueError("written out for three tokens")
    rule = " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{{}}'" .replace("{}", f"{h}{p}|{v}") for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    enough = f"count(*) filter (bad) >= greatest({how.rows}, {how.share} * (select count(*) from basket)) and count(*) filter (bad) / count(*) >= greatest({how.confidence}, (select {how.lift} * sum(b.bad::int) / count(*) from basket b))"
    parts = "regexp_replace(host, '[:@].*', '')"
    return f"""
with u as (
  select page_id, coalesce(url, '') as url, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest, row_number() over () as r from pages
), h as (
  select *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), t as (
  select *, list_distinct(list_concat(list_concat(
    list_transform(list_filter(list_concat(string_split({parts}, '.'), string_split_regex({parts}, '[.-]')), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split_regex(lower(regexp_replace(path, '[0-9]+', '#', 'g')), '[^\\p{{L}}#]+'), lambda x: x <> ''), lambda x: 'p:' || x)),
    list_transform(regexp_extract_all(regexp_extract(rest, '\\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1), lambda x: 'q:' || x))) as tokens from h
), label as (
  select doc_id, bool_or(toxic = 1 or quality = 0) as bad from labels group by 1 having bool_or(toxic = 1 or quality = 0) is not null
), basket as (select r, tokens, bad from t join label on page_id = doc_id where len(tokens) + bad::int > 0),
one as (select r, bad, unnest(tokens) as a from basket),
rules as (
  select [a] as items, count(*) filter (bad) / count(*) as sure from one group by a having {enough}
  union all
  select [x.a, y.a], count(*) filter (x.bad) / count(*) from one x join one y on x.r = y.r and x.a < y.a group by x.a, y.a having {enough.replace('bad)', 'x.bad)')}
  union all
  select [x.a, y.a, z.a], count(*) filter (x.bad) / count(*) from one x join one y on x.r = y.r and x.a < y.a join one z on x.r = z.r and y.a < z.a group by x.a, y.a, z.a having {enough.replace('bad)', 'x.bad)')}
), best as (select r, max(sure) as confidence from t join rules on list_has_all(tokens, items) group by r),
judged as (select page_id, host, path, case {rule} end as fixed, confidence from t left join best using (r))
select page_id, host, path, string_split(fixed, '|')[1] as rule, coalesce(string_split(fixed, '|')[2], case when confidence is null then 'allow' else 'block' end) as verdict, confidence from judged"""
