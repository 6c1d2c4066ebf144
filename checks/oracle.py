"""DuckDB SQL for every named query, written from the rules and not from the Spark code.

Inputs are the same derivations of the test tables as in ``foliospark.plans.fixtures``, spelled in
SQL. Results that pass through JSON in Spark are computed here without any JSON.
"""

from __future__ import annotations


TIME = "'%Y-%m-%d %H:%M:%S'"
WS = r"\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LANGS = "['es','fr','de','pt']"
CENT = "cast(0.01 as decimal(3,2))"
MARK = r"(?s)\[\[ORIGINAL: (.*?)\]\]"
ORDERS_AS_OF = "timestamp '1998-06-01'"
UPLOADS_AS_OF = "timestamp '2024-01-31'"


def t(column: str) -> str:
    return f"strftime({column}, {TIME})"


def words(column: str) -> str:
    return f"cast(len(regexp_extract_all({column}, '[^{WS}]+')) as bigint)"


def tier(w: str) -> str:
    return f"case when {w} <= 30000 then 'small' when {w} <= 80000 then 'medium' else 'large' end"


def name_of(code: str) -> str:
    return f"case {code} when 'es' then 'Spanish' when 'fr' then 'French' when 'de' then 'German' when 'pt' then 'Portuguese' end"


SUFFIX = "['.txt','.docx','.epub','.pdf','.TXT','.v2.txt','']"
SETTING = """case language
 when 'es' then 'Spanish as read across Latin America, plain enough for Spain; address readers with tú.'
 when 'fr' then 'Present-day French of France, in short and clear phrases.'
 when 'de' then 'High German with sentences that are easy to follow.'
 when 'pt' then 'Portuguese as spoken in Brazil, clear to readers in Portugal.' end"""

CTE: dict[str, str] = {}

CTE["manuscripts"] = f"""
select doc_id, source, lang, 's' || doc_id as session_id,
  'my_book_' || doc_id || ({SUFFIX})[cast(doc_id % 7 + 1 as int)] as file_name,
  n_chars as size_bytes, text as content from documents"""
CTE["named"] = """
select *, lower(string_split(file_name, '.')[-1]) as extension,
  replace(regexp_replace(file_name, '\\.[^/.]+$', ''), '_', ' ') as title from manuscripts"""
CTE["intake"] = f"""
select * exclude (content), '.' || extension as file_format, extension in ('txt','docx','epub','pdf') as supported,
  case when extension in ('txt','docx') then {words('content')}
       when extension in ('epub','pdf') then cast(floor(size_bytes / 6.0 + 0.5) as bigint) else 0 end as word_count,
  case when extension in ('txt','docx') then content
       when extension in ('epub','pdf') then '[' || upper(extension) || ' file uploaded - ' || file_name || ']'
       else '' end as content
from named"""
CTE["counted"] = f"select source, lang, {words('text')} as n from documents"
CTE["books"] = """
select 'source:' || source as book_id, cast(sum(n) as bigint) as words, count(*) as documents from counted group by source
union all
select 'lang:' || lang, cast(sum(n) as bigint), count(*) from counted group by lang"""

CTE["order_base"] = f"""
select o_orderkey as order_id, o_custkey as customer_id, 'cs_' || lpad(cast(o_orderkey as varchar), 12, '0') as payment_session_id,
  's' || o_custkey as upload_session_id, 'Author ' || o_custkey as author_name, 'Book ' || o_orderkey as book_title,
  cast(floor(o_totalprice) as bigint) % 160000 + 1 as word_count,
  ['.txt','.docx','.epub','.pdf'][cast(o_custkey % 4 + 1 as int)] as file_format,
  o_orderkey % 5 as n,
  list_slice({LANGS}, 1, o_orderkey % 5) as languages,
  list_filter([case when (o_orderkey // 5) % 2 = 1 then 'launch-pack' end,
    case when (o_orderkey // 10) % 2 = 1 then 'newsletter' end,
    case when (o_orderkey // 20) % 2 = 1 then 'author-list' end,
    case when (o_orderkey // 40) % 2 = 1 then 'full-promo' end,
    case when o_orderkey % 97 = 0 then 'unknown' end], lambda x: x is not null) as upsells,
  case when o_orderkey % 3 = 0 then 'Keep chapter titles short.' end as special_instructions,
  ['LAUNCH20','FIRST50','FRIEND10','AUTHOR25','BETA95','TESTDRIVE','  launch20 ','NOPE',null][cast(o_orderkey % 9 + 1 as int)] as voucher_input,
  cast(o_totalprice as decimal(12,2)) as amount_paid, o_orderpriority as priority,
  case o_orderstatus when 'P' then 'pending' when 'F' then 'completed' else 'processing' end as status,
  o_orderdate as created_at, case when o_orderstatus = 'F' then o_orderdate + interval 3 day end as completed_at
from orders"""
CTE["order_inputs"] = f"select *, {tier('word_count')} as tier from order_base"
CTE["customers"] = """
select order_inputs.*, lower(replace(c_name, '#', '.')) || '@example.com' as email,
  case when priority = '5-LOW' then '' else c_mktsegment end as genre
from order_inputs join customer on c_custkey = customer_id"""
CTE["addon_lines"] = """
select order_id, u as addon_id,
  case u when 'launch-pack' then case when n > 1 then 49 else 29 end when 'newsletter' then 99
    when 'author-list' then 149 when 'full-promo' then 249 else 0 end as price
from (select order_id, n, unnest(upsells) as u from order_inputs)"""
CTE["quoted"] = f"""
select o.*, cast(base * n as decimal(12,2)) as list_price,
  cast(base * n * (100 - off) * {CENT} as decimal(12,2)) as translation_price,
  cast(coalesce(a.addons, 0) as decimal(12,2)) as addon_total,
  cast(base * n * (100 - off) * {CENT} as decimal(12,2)) + cast(coalesce(a.addons, 0) as decimal(12,2)) as total
from (select *, case tier when 'small' then 150 when 'medium' then 350 else 600 end as base,
        [0, 0, 12, 25, 37][cast(least(n, 4) + 1 as int)] as off from order_inputs) o
left join (select order_id, sum(price) as addons from addon_lines group by 1) a using (order_id)"""
CTE["codes"] = """
select * from (values ('LAUNCH20', 20, 'percent', '20% off launch discount'), ('FIRST50', 50, 'fixed', '$50 off first order'),
  ('FRIEND10', 10, 'percent', '10% friend referral'), ('AUTHOR25', 25, 'percent', '25% author discount'),
  ('BETA95', 95, 'percent', '95% beta tester discount'), ('TESTDRIVE', 95, 'percent', '95% test discount'))
  as c(code, discount, discount_kind, description)"""
CTE["discounted"] = f"""
select q.*, c.code as voucher_code, c.discount, c.discount_kind, c.description,
  case when voucher_input is not null and c.code is null then 'unknown_code' end as reject_reason,
  cast(case when c.code is null then 0 when discount_kind = 'percent' then q.total * discount * {CENT}
    else least(cast(discount as decimal(12,2)), q.total) end as decimal(14,4)) as exact
from quoted q left join codes c on c.code = upper(trim(q.voucher_input))"""
CTE["charged"] = """
select *, cast(round(exact, 2) as decimal(12,2)) as discount_amount,
  case when voucher_code is null then total else greatest(total - cast(round(exact, 2) as decimal(12,2)), 1) end as shown_total,
  cast(round(greatest(total - exact, 1), 2) as decimal(12,2)) as charged_total,
  cast(round(greatest(total - exact, 1) * 100, 0) as bigint) as charged_cents
from discounted"""

CTE["carts"] = """
select q.*, e.email, case when q.order_id % 10 = 3 then cast(1 as decimal(12,2)) else cast(q.total as decimal(12,2)) end as claimed
from quoted q join (select order_id, email from customers) e using (order_id)"""
CTE["cart_charges"] = f"""
select k.*, c.code as voucher_code, cast(case when c.code is null then 0 when discount_kind = 'percent' then claimed * discount * {CENT}
    else least(cast(discount as decimal(12,2)), claimed) end as decimal(14,4)) as exact
from carts k left join codes c on c.code = upper(trim(k.voucher_input)) where k.order_id % 50 <> 7"""

CTE["paid"] = f"""
select *, 'cs_' || event_id as payment_session_id, (event_id * 37) % 160000 + 1 as words_,
  cast(floor(value * 100 + 0.5) as bigint) as cents
from events where event_type = 'purchase' and event_id % 11 <> 0"""
CTE["paid_orders"] = f"""
select substr(sha256(payment_session_id), 1, 32) as order_id, payment_session_id, 'user' || user_id || '@example.com' as email,
  'Author ' || user_id as author_name, 'Book "' || event_id || '"' as book_title, words_ as word_count, {tier('words_')} as tier,
  ['.txt','.docx','.epub','.pdf'][cast(event_id % 4 + 1 as int)] as file_format,
  array_to_string(list_slice({LANGS}, 1, event_id % 4 + 1), ',') as languages,
  case when event_id % 5 = 0 then '' else 'Romance' end as genre,
  case when event_id % 5 = 0 then '' else 'newsletter' end as upsells,
  case when event_id % 3 = 0 then 'Keep names.' end as special_instructions,
  cast(cents * {CENT} as double) as amount_paid, case when event_id % 4 = 0 then 'LAUNCH20' end as voucher_code,
  cast(cents * 2 * {CENT} as double) as original_amount, 'pending' as status, {t('ts')} as created_at,
  event_id % 3 + 1 as deliveries, {t('ts')} as delivered_at, event_id
from paid"""

CTE["files"] = f"""
select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as file_id, l_orderkey as order_id,
  'translated' as type, ({LANGS})[cast(l_linenumber % 4 + 1 as int)] as language, l_shipdate as created_at from lineitem"""
CTE["originals"] = """
select (doc_id * 4) // 5 as order_id, doc_id as file_id, file_format, content,
  case when extension in ('txt','docx') then size_bytes > 0 else extension in ('epub','pdf') end as has_text from intake"""
CTE["original_facts"] = """
select order_id, count(*) as originals, bool_or(file_format in ('.epub','.pdf')) as opaque, bool_or(has_text) as filled
from originals group by 1"""
CTE["work"] = """
select c.*, originals, opaque, filled, coalesce(d.done, []) as done,
  list_filter(c.languages, lambda x: not list_contains(coalesce(d.done, []), x)) as pending
from customers c left join original_facts f using (order_id)
left join (select order_id, list(distinct language) as done from files group by 1) d using (order_id)"""
CTE["blocked"] = """
select *, case when originals is null then 'missing_original' when originals > 1 then 'ambiguous_original'
  when opaque then 'opaque_source' when not filled then 'empty_source' when len(languages) = 0 then 'no_languages'
  when len(pending) = 0 then 'nothing_pending' end as reason from work"""
CTE["todo"] = f"""
select b.* exclude (file_format), o.content, language, {name_of('language')} as language_name, {SETTING} as language_setting
from (select *, unnest(pending) as language from blocked where reason is null) b join originals o using (order_id)"""
CTE["todo_all"] = f"""
select b.* exclude (file_format), o.content, language, {name_of('language')} as language_name, {SETTING} as language_setting
from (select *, unnest(languages) as language from blocked where originals = 1 and not opaque and filled) b join originals o using (order_id)"""


def translation_text(genre: str, text: str) -> str:
    g = f"coalesce(nullif(genre, ''), '{genre}')"
    return f"""concat_ws(chr(10), 'Translate this ' || {g} || ' manuscript into ' || language_name || '.',
 'Regional setting: ' || language_setting,
 'Keep paragraphs, blank lines, headings, lists, indentation and markers where they are.',
 'Keep the author''s voice, tone, names and terms; use idioms a native reader would use.',
 'Title: ' || book_title, 'Author: ' || author_name, 'Genre: ' || {g},
 'Instructions from the author: ' || special_instructions, 'Manuscript:', {text}, 'Answer with the translation only.')"""


def editorial_text(text: str, translated: str) -> str:
    return f"""concat_ws(chr(10), 'Edit this ' || language_name || ' translation of a ' || coalesce(nullif(genre, ''), 'general') || ' book so that it reads naturally.',
 'Regional setting: ' || language_setting,
 'Keep the tone of the original, the formatting and everything that is already right.',
 'Before each changed phrase put the old one as [[ORIGINAL: old phrase]].',
 'Original:', {text}, 'Translation:', {translated}, 'Answer with the full edited translation.')"""


CTE["pairs"] = f"""
select u.conv_id, u.turn, u.text as translated, a.text as improved, case when a.conv_id is null then -1 else u.conv_id % 6 end as shape,
  ({LANGS})[cast(u.conv_id % 4 + 1 as int)] as language
from (select * from conversations where role = 'user') u
left join (select * from conversations where role = 'assistant') a on a.conv_id = u.conv_id and a.turn = u.turn + 1"""
CTE["marked"] = """
select doc_id, case
  when doc_id % 4 = 1 then '[[ORIGINAL: ' || substr(text, 1, 20) || ']]' || substr(text, 21) || '[[ORIGINAL: end' || chr(10) || 'note]]The end.'
  when doc_id % 2 = 1 then '[[ORIGINAL: ' || substr(text, 1, 20) || ']]' || substr(text, 21) else text end as text from documents"""
CTE["spans"] = f"""
select doc_id, text, regexp_extract_all(text, '{MARK}', 1) as s, regexp_replace(text, '{MARK}', '', 'g') as published from marked"""
CTE["reformatted"] = """
select doc_id, text as a, case doc_id % 3 when 0 then text when 1 then replace(text, chr(10) || chr(10), chr(10))
  else text || chr(10) || '- first' || chr(10) || '2. second' || chr(10) || '# Notes' || chr(10) end as b from documents"""

CTE["uploads"] = f"""
select 's' || user_id as session_id, event_id as upload_id, ts as created_at,
  'my_book_' || event_id || ({SUFFIX})[cast(event_id % 7 + 1 as int)] as file_name, (event_id * 37) % 160000 + 1 as word_count from events"""
CTE["upload_rows"] = "select *, '.' || lower(string_split(file_name, '.')[-1]) as file_format from uploads"
CTE["staged"] = """
select * exclude (rn) from (select *, row_number() over (partition by session_id order by created_at desc, upload_id desc) as rn,
  count(*) over (partition by session_id) as writes from upload_rows) where rn = 1"""
CTE["status_log"] = """
select user_id as order_id, case event_type when 'signup' then 'pending' when 'view' then 'processing'
  when 'click' then 'completed' else 'failed' end as status, ts as changed_at, event_id as change_id
from events where event_type <> 'purchase'"""
CTE["steps"] = """
select *, lag(status) over (partition by order_id order by changed_at, change_id) as previous from status_log"""
CTE["judged"] = """
select *, (previous is null and status = 'pending')
  or coalesce((previous = 'pending' and status = 'processing') or (previous = 'processing' and status in ('completed','failed'))
  or (previous = 'failed' and status = 'processing'), false) as legal from steps"""
CTE["kept"] = f"""
select * from order_inputs where not coalesce(completed_at + interval 30 day < {ORDERS_AS_OF}, false)"""
CTE["deleted"] = f"""
select * from order_inputs where completed_at + interval 30 day < {ORDERS_AS_OF}"""
CTE["clicks"] = """
select l_orderkey as order_id, ['es','fr','de','pt','xx'][cast(l_partkey % 5 + 1 as int)] as language from lineitem"""
CTE["latest_files"] = """
select order_id, language, file_id, created_at, copies from (
  select *, row_number() over (partition by order_id, language order by created_at desc, file_id desc) as rn,
    count(*) over (partition by order_id, language) as copies from files) where rn = 1"""
CTE["resolved"] = """
select a.order_id, a.language, requests, copies, file_id, f.created_at, book_title,
  case when o.order_id is null then 'order_not_found' when status <> 'completed' then 'not_complete'
    when copies is null then 'translation_not_found' when copies > 1 then 'ambiguous' else 'ok' end as outcome
from (select order_id, language, count(*) as requests from clicks group by 1, 2) a
left join kept o on o.order_id = a.order_id
left join latest_files f on f.order_id = a.order_id and f.language = a.language"""

CTE["plans"] = """
select doc_id, ['es','fr','de','pt','xx'][cast(doc_id % 5 + 1 as int)] as language, 'Book ' || doc_id as book_title,
  'Author ' || source as author_name, text, replace(text, chr(10), ' ') as line,
  case when doc_id % 10 = 9 then 'unreadable' when doc_id % 13 = 0 then 'incomplete' end as parse_reason,
  22 + doc_id % 12 as n_ads, 4 + doc_id % 5 as n_paths, 4 + doc_id % 5 as n_tips, 1 + doc_id % 3 as n_steps,
  list_transform(generate_series(1, case when doc_id % 8 = 7 then 6 else 7 end),
    lambda i: substr(replace(text, chr(10), ' '), i * 60 - 59, 17 + i * 4 + doc_id % 11)) as boxes
from documents"""
CTE["markets"] = """
select * from (values ('es', 'Spanish', 'Spain and Latin America', 'amazon.es / amazon.com.mx'),
  ('fr', 'French', 'France and French-speaking countries', 'amazon.fr'),
  ('de', 'German', 'Germany, Austria, and Switzerland', 'amazon.de'),
  ('pt', 'Portuguese', 'Brazil and Portugal', 'amazon.com.br')) as m(language, market_language, market, store_domain)"""
CTE["rules"] = f"""
select doc_id, parse_reason as reason, readable and len(boxes) = 7 as seven_boxes,
  readable and len(list_filter(boxes, lambda b: length(b) >= 50)) = 0 as boxes_short,
  readable and len(list_filter(boxes, lambda b: regexp_matches(b, '[,"“”]'))) = 0 as boxes_plain,
  readable and len(list_filter(boxes, lambda b: contains(lower(b), lower(book_title)) or contains(lower(b), lower(author_name)))) = 0 as boxes_not_title,
  readable and len(list_filter(boxes, lambda b: regexp_matches(b, '(?i)(^|[^\\p{{L}}\\p{{N}}])(book|ebook)s?($|[^\\p{{L}}\\p{{N}}])'))) = 0 as boxes_not_generic,
  readable and n_ads between 25 and 30 as ad_keywords_ok, readable and n_paths between 5 and 7 as categories_ok, readable and n_tips between 5 and 7 as reviews_ok,
  readable and {words('line')} between 150 and 200 as description_ok, readable and n_steps > 0 as checklist_ok
from (select *, coalesce(parse_reason <> 'unreadable', true) as readable from plans)"""


def _order(names: list[str]) -> list[str]:
    """Named fragments in definition order, with everything they mention."""
    import re

    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name in wanted or name not in CTE:
            continue
        wanted.add(name)
        todo += [n for n in CTE if n != name and re.search(rf"\b(?:from|join)\s+{n}\b", CTE[name])]
    return [n for n in CTE if n in wanted]


def sql(body: str) -> str:
    import re

    used = [n for n in CTE if re.search(rf"\b(?:from|join)\s+{n}\b", body)]
    parts = ", ".join(f"{n} as ({CTE[n]})" for n in _order(used))
    return (f"with {parts} " if parts else "") + body


ORACLES: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    ORACLES[name] = sql(body)


oracle("intake_formats", """
select file_format, supported, count(*) as files, cast(sum(word_count) as bigint) as words, max(word_count) as longest,
  cast(sum(length(content)) as bigint) as staged_chars from intake group by 1, 2""")
oracle("word_counts", "select session_id, extension, title, word_count from intake")
oracle("book_word_totals", "select book_id, words, documents from books")
oracle("opaque_estimates", """
select session_id, session_id || '/original.' || extension as blob_key, size_bytes, word_count as estimated_words,
  content as placeholder from intake where extension in ('epub','pdf')""")
oracle("docx_bulk_extract", f"""
select doc_id, cast(length(c) as bigint) as chars, md5(c) as content_md5, {words('c')} as words, cast(null as varchar) as error
from (select doc_id, replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) as c from documents)""")
oracle("tier_assign", f"select book_id, words, {tier('words')} as tier from books")
oracle("tier_assign_range_join", """
select order_id, word_count, tier, cast(case tier when 'small' then 150 when 'medium' then 350 else 600 end as bigint) as base_price from order_inputs""")
oracle("over_limit_books", "select book_id, words from books where words > 150000")
oracle("quote_orders", """
select order_id, tier, n as n_languages, cast(list_price as double) as list_price, cast(translation_price as double) as translation_price,
  cast(addon_total as double) as addon_total, cast(total as double) as total, word_count > 150000 as over_limit from quoted""")
oracle("quote_books", f"""
select book_id, words as word_count, {tier('words')} as tier, n as n_languages,
  cast(base * n * (100 - [0, 12, 25, 37][cast(n as int)]) * {CENT} as double) as translation_price,
  cast(case when n > 1 then 49 else 29 end as double) as addon_total,
  cast(base * n * (100 - [0, 12, 25, 37][cast(n as int)]) * {CENT} + case when n > 1 then 49 else 29 end as double) as total
from (select *, case when words <= 30000 then 150 when words <= 80000 then 350 else 600 end as base, unnest([1, 2, 3, 4]) as n from books)""")
oracle("addon_totals", """
select addon_id, count(*) as units, cast(sum(price) as bigint) as revenue,
  case addon_id when 'launch-pack' then 'Launch Strategy Pack' when 'newsletter' then 'Newsletter Feature'
    when 'author-list' then 'Author Network Blast' when 'full-promo' then 'Full Promo Package' end as addon_name
from addon_lines group by 1""")
oracle("bundle_savings", """
select n as n_languages, count(*) as orders, cast(sum(list_price) as double) as list_total,
  cast(sum(translation_price) as double) as price_total, cast(sum(list_price - translation_price) as double) as saved
from quoted group by 1""")
oracle("voucher_apply", """
select order_id, voucher_code is not null as valid, voucher_code, cast(discount as bigint) as discount, discount_kind, description,
  reject_reason, cast(case when voucher_code is not null then discount_amount end as double) as discount_amount,
  cast(case when voucher_code is not null then charged_total end as double) as new_total, cast(total as double) as total from charged""")
oracle("voucher_request_answers", """
select order_id, reason is null as valid, case when reason is null then voucher_code end as voucher_code,
  cast(case when reason is null then discount_amount end as double) as discount_amount,
  cast(case when reason is null then charged_total end as double) as new_total, reason as reject_reason
from (select *, case when voucher_input is null then 'missing_code' when order_id % 10 in (0, 1) then 'bad_subtotal'
  when voucher_code is null then 'unknown_code' end as reason from charged)""")
oracle("voucher_reject_reasons", """
select case when reject_reason is not null then reject_reason when voucher_code is not null then 'accepted' else 'no_code' end as outcome,
  voucher_code, count(*) as orders, cast(sum(discount_amount) as double) as discount_total from charged group by 1, 2""")
oracle("voucher_use_limits", f"""
select order_id, case when reason is null then voucher_code end as voucher_code,
  coalesce(reason, reject_reason) as reject_reason,
  cast(case when reason is null then discount_amount else 0 end as double) as discount_amount,
  cast(case when reason is null then shown_total else total end as double) as shown_total,
  case when reason is null then charged_cents else cast(round(greatest(total, 1) * 100, 0) as bigint) end as charged_cents
from (select *, case when voucher_code = 'FRIEND10' then 'expired'
    when voucher_code = 'LAUNCH20' and row_number() over (partition by voucher_code order by created_at, order_id) > 500 then 'used_up'
    when voucher_code = 'BETA95' then 'used_up' end as reason from charged)""")
oracle("charge_lines", """
select order_id, email, 'Book Translation: ' || book_title as line_name,
  format('{:,}', word_count) || ' words (' || tier || ') → ' || upper(array_to_string(languages, ', ')) || ' • ' || upper(file_format)
    || ' format preserved' || case when voucher_code is not null then ' • Voucher: ' || voucher_code else '' end as line_description,
  charged_cents, cast(1 as bigint) as quantity, 'usd' as currency, cast(word_count as varchar) as "m_wordCount",
  case when len(languages) = 0 then '[]' else '["' || array_to_string(languages, '","') || '"]' end as "m_selectedLanguages",
  case when len(upsells) = 0 then '[]' else '["' || array_to_string(upsells, '","') || '"]' end as "m_selectedUpsells",
  cast(cast(total as decimal(12,2)) as varchar) as "m_originalAmount", coalesce(voucher_code, '') as "m_voucherCode",
  cast(charged_total as varchar) as "m_finalAmount"
from charged join (select order_id, email from customers) e using (order_id)""")
oracle("checkout_requests", """
select order_id, 'Book Translation: ' || book_title as line_name,
  format('{:,}', word_count) || ' words (' || tier || ') → ' || upper(array_to_string(languages, ', ')) || ' • ' || upper(file_format)
    || ' format preserved' || case when voucher_code is not null then ' • Voucher: ' || voucher_code else '' end as line_description,
  cast(claimed as double) as total, cast(total as double) as quoted_total, claimed <> total as total_differs, voucher_code,
  cast(round(greatest(claimed - exact, 1) * 100, 0) as bigint) as charged_cents from cart_charges""")
oracle("checkout_rejects", """
select case when order_id % 50 = 7 then 'bad_body' else 'usable' end as reason, count(*) as carts from carts group by 1""")
oracle("price_catalogue", """
select tier, n as n_languages, cast(addon_total as double) as addon_total, voucher_code, count(*) as orders,
  cast(min(total) as double) as total, min(charged_cents) as charged_cents, cast(sum(charged_cents) as bigint) as revenue_cents
from charged group by 1, 2, 3, 4""")
oracle("shown_vs_charged", """
select order_id, cast(total as double) as total, voucher_code, cast(discount_amount as double) as discount_amount,
  cast(shown_total as double) as shown_total, cast(charged_total as double) as charged_total, charged_cents
from charged where shown_total <> charged_total""")

_ORDER = """order_id, payment_session_id, email, author_name, book_title, word_count, tier, file_format, languages, genre,
  upsells, special_instructions, amount_paid, voucher_code, original_amount, status, created_at"""
oracle("payment_events_to_orders", f"select {_ORDER}, deliveries, delivered_at from paid_orders")
oracle("orders_stream", f"select {_ORDER} from paid_orders")
oracle("pending_work_stream", f"""
select order_id, ({LANGS})[cast(p as int)] as language, p as position, cast(null as varchar) as reason from (
  select order_id, unnest(generate_series(1, event_id % 4 + 1)) as p from paid_orders)""")
oracle("rejected_events", """
select case event_type when 'error' then 'bad_body' when 'purchase' then 'bad_languages' else 'ignored_type' end as reason,
  case event_type when 'error' then '' when 'purchase' then 'checkout.session.completed' else 'other.' || event_type end as event_type,
  cast(sum(event_id % 3 + 1) as bigint) as events
from events where event_type <> 'purchase' or event_id % 11 = 0 group by 1, 2""")

oracle("pending_languages", """
select order_id, language, cast(list_position(languages, language) as bigint) as position from todo""")
oracle("request_blockers", "select order_id, reason from blocked where reason is not null")
oracle("translation_requests", f"""
select order_id, language, cast(list_position(languages, language) as bigint) as position, cast(length(r) as bigint) as request_chars, md5(r) as request_md5
from (select *, {translation_text('general', 'content')} as r from todo)""")
oracle("windowed_requests", f"""
select order_id, language, part, cast(length(r) as bigint) as request_chars, md5(r) as request_md5
from (select *, {translation_text('romance', 'substr(content, part * 50000 + 1, 50000)')} as r
  from (select *, unnest(generate_series(0, greatest((length(content) + 49999) // 50000 - 1, 0))) as part from todo))""")
oracle("editorial_requests", f"""
select order_id, language, cast(length(r) as bigint) as request_chars, md5(r) as request_md5
from (select *, {editorial_text('content', "'<' || content || '>'")} as r from todo)""")
# Every line is two characters longer, so the n-th paragraphs belong together. Windows are filled one paragraph
# after the other; one that is too long is dealt out in even parts.
_PLACES = """
(with recursive texts as (select order_id, any_value(content) as content from todo group by 1),
lines as (select order_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as s
  from (select order_id, regexp_extract_all(content, '[^\\n]*\\n+|[^\\n]+') as l from texts)),
sized as (select order_id, i, length(s) as a, length(s) + case when rtrim(s, chr(10)) = '' then 0 else 2 end as b from lines),
parted as (select *, cast(ceil(b / 25000.0) as bigint) as k, sum(a) over w - a as from_a, sum(b) over w - b as from_b
  from sized window w as (partition by order_id order by i)),
filled as (
  select order_id, cast(0 as bigint) as i, cast(0 as bigint) as part, cast(0 as bigint) as next, cast(0 as bigint) as has_a, cast(0 as bigint) as has_b from texts
  union all
  select order_id, i, part, case when k > 1 then part + k else part end, case when k > 1 then 0 else a + old_a end, case when k > 1 then 0 else b + old_b end
  from (select p.order_id, p.i, p.a, p.b, p.k, case when full_up then next + 1 else next end as part,
      case when full_up then 0 else has_a end as old_a, case when full_up then 0 else has_b end as old_b
    from (select f.*, q.i as at, f.has_b > 0 and (f.has_a + q.a > 25000 or f.has_b + q.b > 25000) as full_up
      from filled f join parted q on q.order_id = f.order_id and q.i = f.i + 1) g
    join parted p on p.order_id = g.order_id and p.i = g.at)),
dealt as (select p.*, f.part, unnest(range(0, greatest(k, 1))) as t from parted p join filled f using (order_id, i)),
shared as (select order_id, part + t as part, from_a + a * t // greatest(k, 1) as a0, a * (t + 1) // greatest(k, 1) - a * t // greatest(k, 1) as na,
  from_b + b * t // greatest(k, 1) as b0, b * (t + 1) // greatest(k, 1) - b * t // greatest(k, 1) as nb from dealt)
select order_id, part, cast(min(a0) as bigint) as a0, cast(sum(na) as bigint) as na, cast(min(b0) as bigint) as b0, cast(sum(nb) as bigint) as nb from shared group by 1, 2)"""
oracle("windowed_reviews", f"""
select order_id, language, part, cast(nb as bigint) as translated_chars, md5(concat_ws(chr(10),
  'Edit this ' || language_name || ' translation of a ' || coalesce(nullif(genre, ''), 'romance') || ' book and explain every change.',
  'Original:', substr(content, a0 + 1, na), 'Translation:', substr(translated, b0 + 1, nb),
  'Answer with JSON: {{"editedText": text, "changes": [{{"original", "edited", "reason", "type"}}]}},',
  'type being one of style, dialogue, cultural, description, grammar, consistency.')) as request_md5
from (select *, regexp_replace(content, '([^\\n]+)', '«\\1»', 'g') as translated from todo) join {_PLACES} using (order_id)""")
oracle("two_pass_inference", f"""
select order_id, language, md5(translated) as translated_md5,
  case when language <> 'pt' then '[[ORIGINAL: old]]new ' || length({editorial_text('content', 'translated')}) end as edited,
  language = 'pt' as first_pass_kept, false as empty_translation
from (select *, '<' || {translation_text('general', 'content')} || '>' as translated from todo_all)""")

oracle("editorial_json_parse", """
select conv_id, turn, shape in (0, 2, 3, 4) as parsed, md5(case when shape in (0, 3, 4) then improved else translated end) as edited_md5,
  cast(case when shape in (0, 2) then 2 else 0 end as bigint) as n_changes from pairs""")
oracle("change_counts", """
select language, change_type, count(*) as changes, change_type = 'style' as known_type
from (select language, unnest(['style', 'tone']) as change_type from pairs where shape in (0, 2)) group by 1, 2""")
oracle("improvement_notices", f"""
select order_id, language, improvements, {name_of('language')} || ': ' || improvements || ' improvements' as line
from (select conv_id || '-' || turn as order_id, language, cast(case when shape in (0, 2) then 2 else 0 end as bigint) as improvements from pairs)""")
oracle("mark_spans", """
select doc_id, cast(len(s) as bigint) as n_spans, cast(length(array_to_string(s, '')) as bigint) as marked_chars,
  cast(length(published) as bigint) as published_chars, md5(array_to_string(s, '|')) as spans_md5 from spans""")
oracle("final_text", "select doc_id, md5(published) as published_md5, cast(length(text) as bigint) as marked_length from spans")


def _structure(c: str, side: str) -> str:
    lines = f"string_split({c}, chr(10))"
    return f"""cast(len({lines}) as bigint) as lines_{side},
 cast(len(list_filter({lines}, lambda x: trim(x, ' ' || chr(9)) = '')) - case when ({lines})[-1] = '' then 1 else 0 end as bigint) as blank_lines_{side},
 cast(len(regexp_extract_all({c}, '(?m)^[ \\t]*(?:[-*•]|[0-9]+[.)])[ \\t]')) as bigint) as list_items_{side},
 cast(len(regexp_extract_all({c}, '(?m)^(?:#{{1,6}} |Chapter |CHAPTER )')) as bigint) as headings_{side}"""


oracle("structure_check", f"""
select *, lines_before = lines_after and blank_lines_before = blank_lines_after and list_items_before = list_items_after
  and headings_before = headings_after as preserved
from (select doc_id, {_structure('a', 'before')}, {_structure('b', 'after')} from reformatted)""")
oracle("structure_losses", f"""
with lines as (select doc_id, i, n, rtrim(s, chr(10)) as s, s like '%' || chr(10) as broken,
    case when regexp_matches(s, '^(?:#{{1,6}} |Chapter |CHAPTER )') then 'heading'
      when regexp_matches(s, '^[ \\t]*(?:[-*•]|[0-9]+[.)])[ \\t]') then 'list item' else 'paragraph' end as kind
  from (select doc_id, unnest(range(1, len(l) + 1)) as i, len(l) as n, unnest(l) as s
    from (select doc_id, regexp_extract_all(text, '[^\\n]*\\n+|[^\\n]+') as l from documents)))
select doc_id, 'blank lines lost' as change, kind, i as place, i as place_after from lines where doc_id % 4 = 1 and broken
union all select doc_id, 'retyped', kind, i, i from lines where doc_id % 4 = 2 and kind <> 'list item'
union all select doc_id, 'added', 'heading', n, n + 1 from lines where doc_id % 4 = 3 and i = n""")
oracle("results_by_order", """
select order_id, count(*) as languages, cast(sum(copies) as bigint) as files,
  max(case when language = 'es' then file_id end) as file_es, max(case when language = 'fr' then file_id end) as file_fr,
  max(case when language = 'de' then file_id end) as file_de, max(case when language = 'pt' then file_id end) as file_pt
from latest_files group by 1""")

oracle("staged_upsert", f"select * replace ({t('created_at')} as created_at) from staged")
oracle("staged_stream", f"select * exclude (writes) replace ({t('created_at')} as created_at) from staged")
oracle("live_uploads_stream", f"""
select * exclude (writes) replace ({t('created_at')} as created_at) from staged
where created_at >= (select max(created_at) from staged) - interval 24 hour""")
oracle("expire_staged", f"""
select * replace ({t('created_at')} as created_at) from staged where created_at >= {UPLOADS_AS_OF} - interval 24 hour""")
oracle("promote_originals", f"""
select o.order_id, o.upload_session_id, s.upload_id, 'original' as type, 'en' as language, s.file_name, s.file_format, s.word_count,
  {t('s.created_at')} as uploaded_at from order_inputs o join staged s on s.session_id = o.upload_session_id""")
oracle("retention_due", f"""
select order_id, {t('completed_at + interval 7 day')} as links_until, {t('completed_at + interval 30 day')} as files_until,
  completed_at + interval 7 day < {ORDERS_AS_OF} as links_expired, completed_at + interval 30 day < {ORDERS_AS_OF} as files_due
from order_inputs where completed_at is not null""")
oracle("order_status_latest", f"""
select order_id, status, {t('updated')} as updated_at, {t('completed')} as completed_at, changes from (
  select *, max(changed_at) over (partition by order_id) as updated,
    max(case when status = 'completed' then changed_at end) over (partition by order_id) as completed,
    count(*) over (partition by order_id) as changes,
    row_number() over (partition by order_id order by changed_at desc, change_id desc) as rn from status_log) where rn = 1""")
oracle("status_transitions", "select order_id, change_id, previous, status, legal from judged")
oracle("illegal_transitions", """
select coalesce(previous, '') as previous, status, count(*) as changes, count(distinct order_id) as orders
from judged where not legal group by 1, 2""")



def _timeouts(until: str) -> str:
    return f"""
select * from (with told as (select *, {until} as until from steps where changed_at <= {until}),
late as (select *, lag(status) over w as before, lag(changed_at) over w as since, lead(changed_at) over w as next
  from told window w as (partition by order_id order by changed_at, change_id)),
every as (
  select order_id, changed_at, change_id, case when before = 'processing' and changed_at > since + interval 1 day then 'failed' else before end as previous,
    status, 'change' as cause from late
  union all
  select order_id, changed_at + interval 1 day, null, status, 'failed', 'timeout' from late
  where status = 'processing' and coalesce(next > changed_at + interval 1 day, changed_at + interval 1 day <= until))
select order_id, {t('changed_at')} as changed_at, change_id, previous, status, cause,
  (previous is null and status = 'pending') or coalesce((previous = 'pending' and status = 'processing')
  or (previous = 'processing' and status in ('completed','failed')) or (previous = 'failed' and status = 'processing'), false) as legal from every)"""


oracle("status_with_timeouts", _timeouts("timestamp '2024-01-25'"))
oracle("status_stream", _timeouts("(select date_trunc('millisecond', max(changed_at)) - interval 12 hour from steps)"))
oracle("order_progress", f"""
select order_id, wanted, finished, case when wanted > 0 and finished = wanted then 'completed' when finished > 0 then 'processing' else 'pending' end as status,
  {t('first_at')} as started_at, case when wanted > 0 and finished = wanted then {t('last_at')} end as completed_at
from (select o.order_id, any_value(o.n) as wanted, count(f.first_at) as finished, min(f.first_at) as first_at, max(f.first_at) as last_at
  from order_inputs o left join (select order_id, language, min(created_at) as first_at from files group by 1, 2) f
    on f.order_id = o.order_id and list_contains(o.languages, f.language) group by o.order_id)""")
oracle("status_written", f"""
select order_id, case when finished = wanted then 'completed' else 'processing' end as status,
  case when finished = wanted then {t('last_at')} else {t('first_at')} end as updated_at,
  case when finished = wanted then {t('last_at')} end as completed_at, cast(case when finished = wanted then 2 else 1 end as bigint) as changes
from (select o.order_id, any_value(o.n) as wanted, count(f.first_at) as finished, min(f.first_at) as first_at, max(f.first_at) as last_at
  from order_inputs o join (select order_id, language, min(created_at) as first_at from files group by 1, 2) f
    on f.order_id = o.order_id and list_contains(o.languages, f.language) group by o.order_id)""")
oracle("delivery_resolve", "select order_id, language, requests, outcome, copies, file_id from resolved")
oracle("delivery_manifest", f"""
select order_id, language, file_id, book_title || '_' || coalesce({name_of('language')}, language) || '.txt' as file_name,
  outcome = 'ambiguous' as duplicated, {t('created_at')} as created_at from resolved where outcome in ('ok', 'ambiguous')""")
oracle("delivered_documents", f"""
select order_id, language, file_name, cast(strlen(content) as bigint) as bytes, md5(content) as content_md5
from (select r.order_id, r.language, r.book_title || '_' || coalesce({name_of('r.language')}, r.language) || '.txt' as file_name,
    repeat('Überarbeitet: ' || replace(r.file_id, '-', ' ') || chr(10), cast(split_part(r.file_id, '-', 2) as int) + 1) as content
  from resolved r where outcome in ('ok', 'ambiguous'))""")
_CHANGED = """
(select * replace (case when order_id % 40 > 2 then status when status = 'pending' then 'processing' when status = 'processing' then 'completed' else 'failed' end as status)
 from order_inputs where not (order_id % 40 <= 2 and order_id % 3 = 0))"""
oracle("kept_orders_by_status", f"""
select status, count(*) as orders, cast(sum(amount_paid) as double) as revenue, {t('min(created_at)')} as oldest, {t('max(created_at)')} as newest from {_CHANGED} group by 1""")
oracle("kept_recent_orders", f"""
select order_id, book_title, status, cast(amount_paid as double) as amount_paid, {t('created_at')} as created_at
from {_CHANGED} order by created_at desc, order_id limit 100""")
oracle("manuscript_files", f"""
select source, lang, cast(sum(strlen(replace(text, chr(10), ' ')) + 1) as bigint) as size_bytes,
  cast(sum({words("replace(text, chr(10), ' ')")}) as bigint) as words from documents group by 1, 2""")
oracle("order_lookup", """
select a.order_id, requests, case when k.order_id is null then 0 else 1 end::bigint as matches,
  case when k.order_id is null then 'missing' else 'found' end as outcome
from (select order_id, count(*) as requests from clicks group by 1) a left join kept k using (order_id)""")
oracle("original_lookup", """
select o.order_id, cast(1 as bigint) as requests, coalesce(originals, 0) as matches,
  case coalesce(originals, 0) when 0 then 'missing' when 1 then 'found' else 'ambiguous' end as outcome
from order_inputs o left join original_facts using (order_id)""")
oracle("order_references", "select order_id, right(payment_session_id, 12) as reference from order_inputs")

oracle("notification_outbox", f"""
select order_id, author_name, book_title, genre, format('{{:,}}', word_count) as words_text, upper(file_format) as format_text,
  case when len(upsells) > 0 then array_to_string(upsells, ', ') else 'None' end as upsells_text,
  coalesce(special_instructions, 'None') as instructions_text, kind, email as customer_email,
  case when kind like 'admin%' then 'admin@example.com' else email end as recipient,
  case kind when 'order_confirmation' then 'Order Confirmed: ' || book_title || ' Translation'
    when 'admin_new_order' then 'New Order: ' || book_title || ' - $' || cast(amount_paid as varchar)
    when 'completion' then 'Your translations are ready: ' || book_title
    else 'Translation Complete: ' || book_title end as subject,
  case kind when 'order_confirmation' then upper(array_to_string(languages, ', ')) when 'admin_new_order' then array_to_string(languages, ', ')
    else array_to_string(list_transform(languages, lambda c: {name_of('c')}), ', ') end as languages_text,
  case when kind = 'completion' then array_to_string(list_transform(languages,
    lambda c: {name_of('c')} || '=https://books.example.com/download/' || order_id || '/' || c), ';') end as links
from (select *, unnest(['order_confirmation', 'admin_new_order', 'completion', 'admin_completion']) as kind from customers)
where status = 'completed' or kind in ('order_confirmation', 'admin_new_order')""")
oracle("orphan_files", f"""
select order_id, count(*) as files, {t('max(created_at)')} as newest from files
where order_id not in (select order_id from kept) group by 1""")
oracle("cascade_delete", f"""
select * replace ({t('created_at')} as created_at) from files where order_id not in (select order_id from deleted)""")
oracle("removed_by_cascade", f"""
select language, count(*) as files, {t('max(created_at)')} as newest from files
where order_id in (select order_id from deleted) group by 1""")
oracle("dq_orders", """
select *, cast(no_email::int + no_title::int + no_language::int + repeated_language::int + unknown_language::int + repeated_addon::int
  + bad_format::int as bigint) as failed_checks
from (select order_id, order_id % 11 = 0 as no_email, priority = '1-URGENT' as no_title, n = 0 as no_language,
  order_id % 7 = 0 and n > 0 as repeated_language, order_id % 13 = 0 and n > 0 as unknown_language, order_id % 17 = 0 as repeated_addon,
  order_id % 19 = 0 as bad_format from customers)""")
ORACLES["cascade_rewrite"] = ORACLES["cascade_delete"]
oracle("orders_by_status", f"""
select status, count(*) as orders, cast(sum(amount_paid) as double) as revenue, {t('min(created_at)')} as oldest, {t('max(created_at)')} as newest
from order_inputs group by 1""")
oracle("orders_by_email", f"""
select email, count(*) as orders, cast(sum(amount_paid) as double) as revenue, count(*) filter (status = 'completed') as completed,
  {t('max(created_at)')} as newest from customers group by 1""")
oracle("recent_orders", f"""
select order_id, book_title, status, cast(amount_paid as double) as amount_paid, {t('order_inputs.created_at')} as created_at
from order_inputs order by order_inputs.created_at desc, order_id limit 100""")
oracle("files_by_type_language", f"""
select type, language, count(*) as files, {t('max(created_at)')} as newest from files group by 1, 2""")
oracle("selection_fold", f"""
with a as (select user_id as session_id, ({LANGS})[cast(event_id % 4 + 1 as int)] as item, event_type, ts, event_id from events),
r as (select session_id, max((ts, event_id)) as at from a where event_type = 'signup' group by 1),
s as (select distinct session_id from a where event_type in ('signup', 'click')),
g as (select session_id, unnest({LANGS}) as item from s)
select g.session_id, g.item, count(a.event_id) as toggles
from g left join r on r.session_id = g.session_id
left join a on a.session_id = g.session_id and a.item = g.item and a.event_type = 'click' and (r.at is null or (a.ts, a.event_id) > r.at)
group by g.session_id, g.item, r.at having (count(a.event_id) + case when r.at is null then 0 else 1 end) % 2 = 1""")

oracle("unknown_languages", "select order_id, 'xx' as language, 'unknown_language' as reason, cast(len(languages) + 1 as bigint) as position from order_inputs where order_id % 13 = 0")
oracle("order_improvement_notices", f"""
select * from (with parts as (select conv_id as order_id, ['es','fr','de','pt'][cast(turn % 4 + 1 as int)] as language,
    cast(sum(case when shape in (0, 2) then 2 else 0 end) as bigint) as improvements from pairs group by 1, 2),
called as (select *, {name_of('language')} as language_name from parts)
select order_id, 'improvement_notice' as kind, email as recipient, 'Your translations are ready: ' || book_title as subject, author_name,
  string_agg(language_name || '=https://books.example.com/download/' || order_id || '/' || language, ';' order by language) as links,
  string_agg(language_name || ': ' || improvements || ' improvements', chr(10) order by language) as summary, cast(sum(improvements) as bigint) as improvements
from called join customers using (order_id) group by all)""")
ORACLES["rejected_events_from_files"] = ORACLES["rejected_events"]
oracle("strategy_requests", """
select doc_id, language, case when market is null then 'unknown_market' end as reason,
  cast(length(r) as bigint) as request_chars, md5(r) as request_md5
from (select *, case when market is not null then concat_ws(chr(10),
  'Plan the launch of this book in ' || market_language || ' for ' || market || '.',
  'Title: ' || book_title, 'Author: ' || author_name, 'Genre: Romance', 'Store: ' || store_domain, 'About the book: ' || text,
  'Give 7 keyword boxes under 50 characters without commas, quotes, the title, the author or words like book or ebook;',
  '25-30 ad keywords; 5-7 category paths; e-book and paperback prices with a reason;',
  'a description of 150-200 words; 5-7 review tactics; an upload checklist.',
  'Answer with one JSON object: backendKeywords, adKeywords, categories, pricingRecommendation, bookDescription, reviewStrategy, kdpUploadChecklist.') end as r
  from plans left join markets using (language))""")
oracle("strategy_parse", """
select doc_id, parse_reason as reason, case when ok then len(boxes) end as boxes, case when ok then n_ads end as ad_keywords,
  case when ok then n_paths end as categories, case when ok and doc_id % 13 <> 0 then '€4.99' end as ebook,
  case when ok then md5(line) end as description_md5
from (select *, doc_id % 10 <> 9 as ok from plans)""")
oracle("strategy_contract", """
select *, cast(10 - (seven_boxes::int + boxes_short::int + boxes_plain::int + boxes_not_title::int + boxes_not_generic::int
  + ad_keywords_ok::int + categories_ok::int + reviews_ok::int + description_ok::int + checklist_ok::int) as bigint) as broken_rules
from rules""")


def _list(word: str, n: str, sep: str, prefix: str = "") -> str:
    return f"array_to_string(list_transform(generate_series(1, {n}), lambda i: '{prefix}' || i || '. {word} ' || i), {sep})"


def _section(head: str, *lines: str) -> str:
    rule = f"'{'━' * 66}'"
    return ", ".join([rule, head, rule, "''", *lines, "''", "''"])


_BOXES = ", ".join(f"'Box {i}: ' || coalesce(boxes[{i}], '')" for i in range(1, 8))
_DOUBLE = f"'{'═' * 67}'"
_NL = "chr(10)"
_DOCUMENT = f"""concat_ws(chr(10), {_DOUBLE}, '📚 LAUNCH PLAN', book_title || ' — ' || market_language || ' (' || market || ')', {_DOUBLE}, '',
{_section("'🔑 KEYWORD BOXES FOR THE STORE'", _BOXES)},
{_section("'🎯 KEYWORDS FOR PAID ADS'", _list('keyword', 'n_ads', _NL))},
{_section("'📂 CATEGORY PATHS'", _list('path', 'n_paths', _NL))},
{_section("'💰 PRICES'", "'Ebook:     €4.99'", "'Paperback: €12.99'", "''", "'Why: Local average'")},
{_section("'📝 DESCRIPTION FOR THE STORE PAGE'", 'line')},
{_section("'⭐ HOW TO GET REVIEWS IN ' || upper(market)", _list('tip', 'n_tips', _NL + ' || ' + _NL))},
{_section("'✅ BEFORE UPLOADING TO ' || upper(store_domain)", _list('step', 'n_steps', _NL + ' || ' + _NL, '☐ '))},
{_DOUBLE}, 'Generated by Folio', {_DOUBLE})"""
oracle("strategy_render", f"""
select doc_id, language, reason, cast(length(document) as bigint) as document_chars, md5(document) as document_md5
from (select *, case when reason is null then {_DOCUMENT} end as document
  from (select *, coalesce(parse_reason, case when market is null then 'unknown_market' end) as reason from plans left join markets using (language)))""")
