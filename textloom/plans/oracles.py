"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

SIZE, OVERLAP, EXPAND, DIM = 100, 20, 60, 64

# Runs, which are cut to tokens afterwards: counted repeats of such large classes are slow here.
RUN = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+'"
BLANK = r"'^[\s\x{0B}\p{Z}\x{FEFF}]+|[\s\x{0B}\p{Z}\x{FEFF}]+\z'"
SENTENCE = r"'[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*'"
CLAUSE = r"'[^,.;。？！]+[,.;。？！]*|[,.;。？！]+'"
WORD = r"'\s*\S+\s*\z|\s*\S+|\s+'"
CHARACTER = r"'(?s).'"
EDGE = r"(^|[^\p{L}\p{N}])"


def _width(run: str) -> str:
    return rf"(case when regexp_matches({run}[1], '[\p{{L}}\p{{N}}]') then 24 else 8 end)"


def _n_tokens(text: str) -> str:
    pieces = f"case when len(r) <= 8 then 1 else (len(r) + {_width('r')} - 1) // {_width('r')} end"
    return f"coalesce(list_sum([{pieces} for r in regexp_extract_all({text}, {RUN})]), 0)::int"


def _tokens(text: str) -> str:
    cut = f"[substr(r, i * {_width('r')} + 1, {_width('r')}) for i in range(0, (len(r) + {_width('r')} - 1) // {_width('r')})]"
    return f"flatten([case when len(r) <= 8 then [r] else {cut} end for r in regexp_extract_all({text}, {RUN})])"


def _paragraphs(text: str) -> str:
    gap = "chr(10) || chr(10) || chr(10)"
    parts = f"string_split({text}, {gap})"
    rest = f"[{gap} || x for x in {parts}[2:]]"
    return f"list_filter(list_concat({parts}[:1], {rest}), lambda x: x <> '')"


def _sentences(text: str) -> str:
    dot = "chr(64976)"
    simple = "dr|vs|mr|ms|mx|mrs|prof|inc|corp|co|llc|ltd|etc"
    quiet = text
    for pattern, replacement in [
        (rf"(?i){EDGE}({simple})\.", rf"'\1\2' || {dot}"),
        (rf"(?i){EDGE}(i)\.(e)\.", rf"'\1\2' || {dot} || '\3' || {dot}"),
        (rf"(?i){EDGE}(a)\.(s)\.(a)\.(p)\.", rf"'\1\2' || {dot} || '\3' || {dot} || '\4' || {dot} || '\5' || {dot}"),
        (r"([0-9])\.([0-9])", rf"'\1' || {dot} || '\2'"),
        (r"([0-9])\.([0-9])", rf"'\1' || {dot} || '\2'"),
    ]:
        quiet = f"regexp_replace({quiet}, '{pattern}', {replacement}, 'g')"
    return f"[replace(s, {dot}, '.') for s in regexp_extract_all({quiet}, {SENTENCE})]"


def _matches(pattern: str):
    return lambda text: f"regexp_extract_all({text}, {pattern})"


def _pieces(source: str = "documents") -> str:
    """CTEs up to ``pieces(doc_id, pos, t, n)``."""
    levels = [_paragraphs, _sentences, _matches(CLAUSE), _matches(WORD), _matches(CHARACTER)]
    ctes = [f"l0 as (select doc_id, []::int[] as pos, text as t, {_n_tokens('text')} as n from {source} where length(text) > 0)"]
    for i, level in enumerate(levels, 1):
        ctes.append(
            f"p{i} as (select doc_id, pos, case when n > {SIZE} then {level('t')} else [t] end as parts from l{i - 1})"
        )
        ctes.append(f"u{i} as (select doc_id, pos, unnest(parts) as t, generate_subscripts(parts, 1) as i from p{i})")
        ctes.append(f"l{i} as (select doc_id, list_append(pos, i::int) as pos, t, {_n_tokens('t')} as n from u{i})")
    ctes.append("pieces as (select * from l5)")
    return ",\n".join(ctes)


def _chunks(source: str = "documents") -> str:
    """CTEs up to ``packed`` (untrimmed) and ``chunks(doc_id, chunk_ix, text)``."""
    return f"""{_pieces(source)},
lens as (select doc_id, list(n order by pos) as ns, list(t order by pos) as ts from pieces group by doc_id),
fold(doc_id, i, s, cur, es, ee) as (
  select doc_id, 0, 0, 0::bigint, null::int, null::int from lens
  union all
  select doc_id, i + 1, case when closing then i - k else s end,
         case when closing then coalesce(list_sum(ns[i - k + 1:i]), 0)::bigint + x else cur + x end,
         case when closing then s end, case when closing then i end
  from (
    select *, case when closing then
        len(list_filter(range(s, i), lambda j: coalesce(list_sum(ns[j + 1:i]), 0) <= {OVERLAP}))::int else 0 end as k
    from (
      select f.*, l.ns, l.ns[f.i + 1] as x, f.cur + l.ns[f.i + 1] > {SIZE} and f.i > 0 as closing
      from fold f join lens l using (doc_id) where f.i < len(l.ns)
    )
  )
),
bounds as (
  select doc_id, es as s, ee as e from fold where es is not null
  union all
  select f.doc_id, f.s, f.i from fold f join lens l using (doc_id) where f.i = len(l.ns)
),
packed as (
  select doc_id, (row_number() over (partition by doc_id order by e))::int - 1 as chunk_ix,
         array_to_string(ts[s + 1:e], '') as text, e - s as n_pieces,
         list_sum(ns[s + 1:e])::int as n_packed
  from bounds join lens using (doc_id)
),
trimmed as (select doc_id, chunk_ix as c, regexp_replace(text, {BLANK}, '', 'g') as text from packed),
chunks as (
  select doc_id, (row_number() over (partition by doc_id order by c))::int - 1 as chunk_ix, text
  from trimmed where text <> ''
)"""


def _bucket(token: str) -> str:
    return f"(('0x' || substr(md5({token}), 1, 8))::bigint % {DIM})::int"


def _hashed(source: str, keys: str) -> str:
    """``keys, v``: token counts per bucket, dense. A chunk is never blank, so each has a token."""
    tokens = f"(select {keys}, unnest({_tokens('text')}) as tok from {source})"
    counts = f"(select {keys}, {_bucket('tok')} as b, count(*)::double as n from {tokens} group by all)"
    entries = f"(select {keys}, map(list(b), list(n)) as m from {counts} group by {keys})"
    return f"(select {keys}, [coalesce(m[b::int], 0)::double for b in range({DIM})] as v from {entries})"


CENTROID = (
    "centroid as (select list(x order by i) as q from (select i, avg(embedding[i]::double) as x "
    f"from embeddings, range(1, {DIM + 1}) r(i) group by i))"
)


def _cosine(a: str, b: str) -> str:
    return f"coalesce(round(list_cosine_similarity({a}, {b}), 10), 0)"


def _page(n: int, offset: int, where: str = "true") -> str:
    return f"""with {CENTROID},
scored as (select vec_id, label, {_cosine('embedding::double[]', 'q')} as score from embeddings, centroid where {where}),
ranked as (select *, row_number() over (order by score desc, vec_id) as rank, count(*) over () as total from scored)
select rank, vec_id, label, score, total > {offset + n} as has_more from ranked
where rank > {offset} and rank <= {offset + n}"""


FILTERABLE = (
    "(select doc_id, lang, source, n_chars, quality, string_split(text, ' ') as words "
    "from documents left join labels using (doc_id))"
)

FILTERS = {
    "filter_eq": "quality = 1",
    "filter_ne": "quality is null or quality <> 1",
    "filter_gt": "n_chars > 900",
    "filter_lt": "n_chars < 1000",
    "filter_ge": "source >= 'src15'",
    "filter_le": "source <= 'src15'",
    "filter_in": "lang in ('de', 'es')",
    "filter_nin": "quality is null or quality not in (0)",
    "filter_any": "list_has_any(words, ['the', 'les'])",
    "filter_all": "list_has_all(words, ['the', 'of'])",
    "filter_text_match": "contains(lower(source), 'rc1')",
    "filter_contains": "list_contains(words, 'and')",
    "filter_is_empty": "quality is null",
    "filter_all_of": "lang = 'en' and n_chars >= 500 and (quality is null or quality <> 0) and list_contains(words, 'the')",
    "filter_none": "true",
}


def _expanded(source: str, partition: str, blank: bool) -> str:
    doc = "case when variant = 0 then doc_id end" if blank else "doc_id"
    return f"""around as (
  select *, lag(text) over w as prev, lead(text) over w as nxt, {_n_tokens('text')} as own
  from {source} window w as ({partition} order by doc_id, chunk_ix)
),
grown as (
  select doc_id, chunk_ix, 0 as variant, text from around
  union all select doc_id, chunk_ix, 1, text || ' ' || nxt from around where own <= {EXPAND} and nxt is not null
  union all select doc_id, chunk_ix, 2, prev || ' ' || text || ' ' || nxt from around
    where own <= {EXPAND} and nxt is not null and prev is not null
)
select {doc} as doc_id, chunk_ix, variant, {_n_tokens('text')} as n_tokens, variant > 0 as is_expanded, text from grown"""


TURNS = "turns as (select conv_id as doc_id, turn as chunk_ix, text from conversations)"


def oracles() -> dict[str, str]:
    chunks, pieces = _chunks(), _pieces()
    scored_text = f"""h as {_hashed('chunks', 'doc_id, chunk_ix')},
q as {_hashed("(select item_id, text from benchmark)", 'item_id')}"""
    return {
        "csv_roundtrip": "select doc_id, text, lang, source, n_chars::varchar as n_chars from documents",
        "metadata_map": """select doc_id, text, key, value from (
            select doc_id, text, unnest(['lang', 'source', 'n_chars']) as key,
                   unnest([coalesce(lang, ''), coalesce(source, ''), coalesce(n_chars::varchar, '')]) as value from documents)""",
        "unpivot_text": """select conv_id, turn, 'text' as text_column, text, 'role' as key, role as value from conversations
            union all select conv_id, turn, 'role', role, 'text', text from conversations""",
        "require_documents": "select count(*) as n_documents from documents",
        "upsert_documents": """select doc_id, text, lang from documents where doc_id not in (select doc_id from labels)
            union all select doc_id, 'second edition: ' || text, lang from documents join labels using (doc_id)
            union all select -1 - conv_id * 1000 - turn, text, role from conversations""",
        "store_roundtrip": f"""with recursive {chunks}
            select 1 as set_id, doc_id, chunk_ix, {_n_tokens('text')} as n_tokens, {DIM} as dimension, text from chunks""",
        "stream_ingest": f"""with recursive streamed as (
              select doc_id, text, lang from documents union all select -1 - item_id, text, 'en' from benchmark),
            {_chunks('streamed')}
            select doc_id, chunk_ix, c.text as text, lang from chunks c join streamed using (doc_id)""",
        "upsert_stored": """with d as (
              select doc_id, case when doc_id in (select doc_id from labels) then 'second edition: ' || text else text end as text from documents
              union all select -1 - conv_id * 1000 - turn, text from conversations)
            select doc_id, text, (select count(*) from d) as total_documents from d""",
        "sets_left": "select 'items' as name, count(*) as total_documents, 1::bigint as total from benchmark",
        "filter_empty_text": "select doc_id from documents where lang is null or lang in ('en', 'de')",
        "paragraph_chunks": f"""with recursive talks as (
              select conv_id as doc_id, string_agg(text, chr(10) || chr(10) || chr(10) order by turn) as text from conversations group by conv_id),
            {_chunks('talks')}
            select doc_id, chunk_ix, text from chunks""",
        "batch_page": f"""with scored as (
              select q.vec_id as query_id, e.vec_id as vec_id, {_cosine('e.embedding::double[]', 'q.embedding::double[]')} as score
              from embeddings e, embeddings q where q.vec_id % 100 = 0),
            ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scored)
            select *, (select count(*) from embeddings) > 10 as has_more from ranked where rank between 6 and 10""",
        "preview_cost": f"""with recursive {chunks},
            total as (select sum({_n_tokens('text')})::bigint as token_count from chunks)
            select 'text-embedding-3-small' as model, token_count, 0.02::double as price_per_1m,
                   token_count * (0.02::double / 1000000.0::double) as estimated_price from total""",
        **dict.fromkeys(("search_stored", "search_indexed"), f"""with recursive {chunks}, {scored_text},
            scored as (select doc_id, chunk_ix, {_cosine('h.v', 'q.v')} as score
                       from h, q where item_id = (select min(item_id) from benchmark)
                         and doc_id in (select doc_id from documents where lang is null or lang <> 'de')),
            ranked as (select *, row_number() over (order by score desc, doc_id, chunk_ix) as rank, count(*) over () > 13 as has_more
                       from scored qualify rank between 6 and 13)
            select rank, c.text as text, score, doc_id as source_doc_id, has_more, source
            from ranked join chunks c using (doc_id, chunk_ix) join documents using (doc_id)"""),
        "ingest": f"""with recursive {chunks}
            select doc_id, lang, chunk_ix, {_n_tokens('c.text')} as n_tokens, c.text as text
            from chunks c join documents using (doc_id)""",
        "fetch_stored": """select doc_id, text, source from documents
            where doc_id in (select min(doc_id) from documents group by source, lang)""",
        "filter_stored_numbers": f"""with recursive {chunks}
            select doc_id, chunk_ix, c.text as text from chunks c join documents using (doc_id) where n_chars >= 1500 and doc_id < 200""",
        "get_documents": """select doc_id, text, source from documents
            where doc_id in (select doc_id from labels where quality = 1)""",
        "missing_documents": """select distinct event_id as doc_id from events
            where event_id not in (select doc_id from documents)""",
        "drop_empty_text": "select doc_id, text from documents where text is not null and length(text) > 0",
        "embed_input": f"with recursive {chunks} select doc_id, chunk_ix, text from chunks",
        **{name: f"select doc_id from {FILTERABLE} where {where}" for name, where in FILTERS.items()},
        "token_count": f"select doc_id, {_n_tokens('text')} as n_tokens from documents",
        "sentence_split": f"""select doc_id, (generate_subscripts(s, 1) - 1)::int as pos, unnest(s) as text
            from (select doc_id, {_sentences('text')} as s from documents)""",
        "piece_split": f"""with {pieces}
            select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as pos, t as text, n as n_tokens from pieces""",
        "pack_chunks": f"with recursive {chunks} select doc_id, chunk_ix, text, n_pieces, n_packed from packed",
        "clean_chunks": f"with recursive {chunks} select doc_id, text from chunks",
        "chunk_documents": f"""with recursive {chunks}
            select doc_id, chunk_ix, {_n_tokens('text')} as n_tokens, text from chunks""",
        "expand_document": f"with {TURNS}, {_expanded('turns', 'partition by doc_id', False)}",
        "expand_corpus": f"with {TURNS}, {_expanded('turns', '', True)}",
        "chunk_and_expand": f"""select doc_id, chunk_ix, variant, text from (
            with recursive {chunks}, {_expanded('chunks', 'partition by doc_id', False)})""",
        "mock_embed": """select doc_id, i::int as i, case when i = 0 then 1.0 else 0.0 end::float as x, 1.0::double as norm
            from documents, range(6) r(i)""",
        "hash_embed": f"""select doc_id, {_bucket('tok')} as bucket, count(*) as n
            from (select doc_id, unnest({_tokens('text')}) as tok from documents) group by all""",
        "function_embed": """select doc_id, length(text) as n_chars, length(text) - length(replace(text, ' ', '')) as n_spaces,
            length(text) - length(replace(text, '.', '')) as n_stops from documents""",
        "dimension_check": f"""select vec_id, model, size, expected from (
            select vec_id, 'm' || label as model, len(embedding)::int as size,
                   case label when 1 then 32 when 2 then 128 else {DIM} end as expected from embeddings)
            where size <> expected""",
        "similarity": f"with {CENTROID} select vec_id, {_cosine('embedding::double[]', 'q')} as score from embeddings, centroid",
        "topk_page": _page(10, 20),
        "search_pivots": _page(10, 20),
        "topk_has_more": _page(100_000_000, 50),
        "search_filtered": _page(15, 0, "label in (1, 3, 5)"),
        "search_hits": f"""select rank, 'label ' || label as text, score, label::varchar as label, vec_id as source_doc_id, has_more
            from ({_page(12, 0, "label <> 2")})""",
        "search_batch": f"""with means as (
              select label, list(x order by i) as q from (select label, i, avg(embedding[i]::double) as x
              from embeddings, range(1, {DIM + 1}) r(i) group by label, i) group by label),
            scored as (select m.label as query_id, vec_id, {_cosine('embedding::double[]', 'q')} as score from embeddings, means m)
            select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score
            from scored qualify rank <= 10""",
        "search_batch_text": f"""with recursive {chunks}, {scored_text},
            scored as (select item_id as query_id, doc_id, chunk_ix, {_cosine('h.v', 'q.v')} as score from h, q)
            select query_id, row_number() over (partition by query_id order by score desc, doc_id, chunk_ix) as rank,
                   doc_id, chunk_ix, score from scored qualify rank <= 5""",
        "search_text": f"""with recursive {chunks}, {scored_text},
            scored as (select doc_id, chunk_ix, {_cosine('h.v', 'q.v')} as score
                       from h, q where item_id = (select min(item_id) from benchmark)),
            ranked as (select *, row_number() over (order by score desc, doc_id, chunk_ix) as rank, count(*) over () > 10 as has_more
                       from scored qualify rank <= 10)
            select rank, doc_id, chunk_ix, c.text as text, score, has_more, source as doc_source, lang as doc_lang
            from ranked join chunks c using (doc_id, chunk_ix) join documents using (doc_id)""",
        "attach_source": """select event_id as doc_id, event_type, quality, source as source_source, n_chars as source_n_chars
            from events left join labels on event_id = labels.doc_id left join documents on event_id = documents.doc_id""",
        "estimate_cost": f"""with recursive {chunks},
            total as (select sum({_n_tokens('text')})::bigint as token_count from chunks)
            select model, token_count, price_per_1m, token_count * (price_per_1m / 1000000.0::double) as estimated_price
            from total, (values ('text-embedding-3-small', 0.02::double), ('text-embedding-3-large', 0.13::double),
                                ('mistral-embed', 0.1::double), ('no-such-model', 0.0::double)) m(model, price_per_1m)""",
        "preview_middle": f"""with recursive {chunks},
            placed as (select doc_id, lang, row_number() over (order by doc_id) - 1 as place, count(*) over () as total from documents)
            select doc_id, chunk_ix, c.text as text, lang from chunks c join placed using (doc_id)
            where place >= total // 2 and place < total // 2 + 10""",
        "docs_per_set": "select source as set_id, count(*) as total_documents from documents group by source",
        "list_sets": """with s as (select user_id as set_id, max(ts) as d, count(*) as total_documents from events group by user_id)
            select set_id, strftime(d, '%Y-%m-%dT%H:%M:%S.%gZ') as upload_date, total_documents,
                   (select count(*) from s) as total from s order by d desc, set_id limit 10 offset 10""",
        "get_set": """select user_id as set_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%gZ') as upload_date
            from events where user_id = 7 group by user_id""",
        "delete_set": "select doc_id, source as set_id, text from documents where source <> 'src3'",
        "sanitize_name": "select page_id, regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g') as name from pages",
        "capitalize_first": "select conv_id, turn, upper(role[1]) || role[2:] as role from conversations",
        "mask_middle": """select c_custkey,
              case when length(c_name) > 16 then left(c_name, 8) || '*******' || right(c_name, 8) else nullif(c_name, '') end as masked_name,
              case when length(c_mktsegment) > 8 then left(c_mktsegment, 4) || '*******' || right(c_mktsegment, 4)
                   else nullif(c_mktsegment, '') end as masked_segment
            from customer""",
        "parse_params": """select event_id, (props->>'k')::int as k, to_json({'type': event_type})::varchar as json from events""",
        "iso_timestamp": """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as iso,
            strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') as parsed from events""",
        "join_spaced": "select conv_id, turn, role || ' ' || text as joined from conversations",
    }
