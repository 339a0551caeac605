"""The registered queries again, as SQL over the same tables.

Each statement is written from the meaning of the operator and shares only the SELECT
that derives the captured records (`capture_view.CAPTURE_SQL`) with the Spark side.
"""

from __future__ import annotations

from .capture_view import CAPTURE_SQL

_TEXT_TYPE = "regexp_matches(lower(coalesce({}, '')), 'text/|json|xml|javascript|html|x-www-form-urlencoded')"
_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> ''))"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"

_URL = r"""
  nullif(lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)), '') AS scheme,
  lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)) AS host,
  TRY_CAST(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/:?#]*:([0-9]+)', 1), '') AS INT) AS port,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS raw_path,
  nullif(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '') AS query
"""

# Request bodies are JSON and therefore text; `{req_text_flag}` switches that off for the
# line format, which knows no request content type.
_BASE = f"""
WITH cap AS ({CAPTURE_SQL}),
parts AS (SELECT *, {_URL} FROM cap),
fl AS (
  SELECT *, CASE WHEN raw_path = '' THEN '/' ELSE raw_path END AS path,
         sha256(resp_text) AS resp_body_sha, sha256(req_text) AS req_body_sha,
         'replay' AS source_tool
  FROM parts
),
obs AS (
  SELECT resp_body_sha AS sha256, strlen(resp_text) AS size, {_TEXT_TYPE.format('content_type')} AS is_text,
         id * 2 + 1 AS seq, ts, resp_text AS content FROM fl WHERE resp_text IS NOT NULL
  UNION ALL
  SELECT req_body_sha, strlen(req_text), true, id * 2, ts, req_text FROM fl WHERE req_text IS NOT NULL
),
bodies AS (
  SELECT sha256, max(size) AS size, arg_min(is_text, seq) AS is_text, bool_or(is_text) AS ever_text,
         count(*) AS seen_count, min(ts) AS first_seen, any_value(content) AS content
  FROM obs GROUP BY sha256
),
words AS (
  SELECT sha256, {_TOKENS.format("replace(content, chr(0), '')")} AS tokens
  FROM bodies WHERE ever_text
)
"""

_TAG_CASES = {
    "f5-big-ip": "contains(lower(coalesce(h_set_cookie, '')), 'bigipserver')",
    "akamai": "coalesce(lower(h_server) = 'akamaighost', false) OR contains(lower(coalesce(h_extra_name, '')), 'x-akamai')",
    "cloudfront": "contains(lower(coalesce(h_via, '')), 'cloudfront')",
    "cloudflare": "coalesce(h_server = 'cloudflare', false) OR coalesce(h_extra_name = 'CF-RAY', false)",
    "apigee": "contains(lower(concat_ws(' ', h_server, h_via, h_set_cookie, h_extra_value)), 'apigee')"
    " OR contains(substring(body, 1, 2000), '\"fault\"')",
    "aem-dispatcher": "coalesce(h_extra_name = 'X-Vhost' AND contains(lower(h_extra_value), 'dispatcher'), false)",
    "nginx": "contains(lower(coalesce(h_server, '')), 'nginx')",
    "apache": "contains(lower(coalesce(h_server, '')), 'apache')",
    "iis-aspnet": "coalesce(h_extra_name = 'X-AspNet-Version', false)",
    "graphql": "contains(substring(body, 1, 500), '\"errors\"') AND contains(lower(substring(body, 1, 2000)), 'graphql')",
    "waf-generic": "coalesce(status IN (403, 406, 419), false) AND (contains(lower(substring(body, 1, 500)), 'access denied')"
    " OR contains(lower(substring(body, 1, 500)), 'request blocked'))",
}
_PAGED = {"paged": "contains(coalesce(query, ''), 'page=')"}
_LICENSE = {"mentions-license": "contains(lower(body), 'license')"}
_SHORT = {"short-page": "h_server IS NOT NULL AND coalesce(status = 200, false) AND length(body) BETWEEN 1 AND 499"}


def _tagged(**more: dict[str, str]) -> str:
    cases = dict(_TAG_CASES)
    for extra in more.values():
        cases.update(extra)

    def tag_list(rules: dict[str, str]) -> str:
        marks = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items())
        return f"list_filter([{marks}], lambda t: t IS NOT NULL)"

    return f"""{_BASE},
texts AS (SELECT fl.*, CASE WHEN b.is_text THEN fl.resp_text ELSE '' END AS body
          FROM fl LEFT JOIN bodies b ON b.sha256 = fl.resp_body_sha),
tagged AS (SELECT *, {tag_list(cases)} AS tag_list, {tag_list(_TAG_CASES)} AS base_tags FROM texts),
flows AS (SELECT *, array_to_string(tag_list, ',') AS tags FROM tagged)
"""


_FLOWS = _tagged()
_SUMMARY = "id, ts, method, status, url, host, tags AS fingerprints, session_id, program"
_NEWEST = "ORDER BY ts DESC, id DESC"
_SHAPE_KEY = (
    "sha256(host || '|' || method || '|' || path || '|' || coalesce(CAST(status AS VARCHAR), 'None')"
    " || '|' || coalesce(resp_body_sha, ''))"
)
_REQ_HEADERS = (
    "concat('Host=', host, ';Accept=*/*;Cookie=sid=''', session_id, '''',"
    " CASE WHEN req_text IS NOT NULL THEN concat(';Content-Type=application/json;Content-Length=', length(req_text)) ELSE '' END)"
)


def _entries(*names: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {value} IS NOT NULL THEN {{'n': strlen({name}), 'k': {name}, 'v': {value}}} END" for name, value in names)
    return (
        f"array_to_string(list_transform(list_sort(list_filter([{items}], lambda e: e IS NOT NULL)),"
        " lambda e: e.k || '=' || e.v), ';')"
    )


_RESP_NAMES = (("'Server'", "h_server"), ("'Via'", "h_via"), ("'Set-Cookie'", "h_set_cookie"), ("h_extra_name", "h_extra_value"))
_RESP_HEADERS = _entries(*_RESP_NAMES)
_RESP_HEADERS_TYPED = _entries(*_RESP_NAMES, ("'Content-Type'", "content_type"))


def _quoted(text: str) -> str:
    """Single-quoted for a shell; chr(39) is the quote, chr(92) the backslash."""
    inner = "chr(39) || chr(92) || chr(39) || chr(39)"
    return f"(chr(39) || replace({text}, chr(39), {inner}) || chr(39))"


_CURL = " || ".join(
    (
        "'curl -sk -X ' || method || ' '",
        _quoted("url"),
        "' -H '",
        _quoted("'Host: ' || host"),
        "' -H '",
        _quoted("'Accept: */*'"),
        "' -H '",
        _quoted("'Cookie: sid=' || chr(39) || session_id || chr(39)"),
        f"CASE WHEN req_text IS NOT NULL THEN ' -H ' || {_quoted("'Content-Type: application/json'")}"
        " || ' --data-binary @-' ELSE '' END",
    )
)


def _select(what: str, rest: str = "", flows: str = _FLOWS) -> str:
    return f"{flows} SELECT {what} FROM flows {rest}"


def _found(where: str, limit: int | None = 50) -> str:
    return _select(_SUMMARY, f"WHERE {where}" + (f" {_NEWEST} LIMIT {limit}" if limit else ""))


def _hits(*words: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"(SELECT sha256 FROM words WHERE list_has_all(tokens, [{listed}]))"


def _score(hay: str, *terms: str) -> str:
    parts, present = [], []
    for t in terms:
        at = f"instr({hay}, '{t}')"
        hits = f"(length({hay}) - length(replace({hay}, '{t}', ''))) // {len(t)}"
        edge = f"({at} = 1 OR contains('/.:-_?&=', substr({hay}, {at} - 1, 1)))"
        parts.append(f"(100 - least({at} - 1, 99) + {hits} + CASE WHEN {edge} THEN 20 ELSE 0 END)")
        present.append(f"{at} > 0")
    return f"CAST(CASE WHEN {' AND '.join(present)} THEN {' + '.join(parts)} ELSE 0 END AS INT)"


def _offsets(hay: str, *terms: str) -> str:
    spans = []
    for t in terms:
        pieces = f"string_split({hay}, '{t}')"
        starts = (
            f"list_transform(range(1, len({pieces})), lambda i: CAST(list_sum(list_transform("
            f"({pieces})[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * {len(t)})"
        )
        spans.append(f"flatten(list_transform({starts}, lambda s: range(s, s + {len(t)})))")
    present = " AND ".join(f"contains({hay}, '{t}')" for t in terms)
    union = f"list_sort(list_distinct(list_concat({', '.join(spans)})))"
    return f"CASE WHEN {present} THEN array_to_string({union}, ',') END"


def _shape_table(program: str = "arg_min(program, struct_pack(t := ts, i := id))", tool: str = "'replay'") -> str:
    return f"""SELECT {_SHAPE_KEY} AS shape_sha, {program} AS program, {tool} AS source_tool,
  any_value(method) AS method, any_value(host) AS host, any_value(path) AS path,
  any_value(status) AS status, any_value(resp_body_sha) AS resp_body_sha,
  count(*) AS hit_count, min(ts) AS first_seen, max(ts) AS last_seen"""


_SHAPES = f"{_FLOWS} {_shape_table()}, '' AS tags FROM flows GROUP BY shape_sha"

# The line format: no empty bodies, no text flag for requests.
_LINES = _BASE.replace("({0})".format(CAPTURE_SQL), f"(SELECT * REPLACE (nullif(resp_text, '') AS resp_text, nullif(req_text, '') AS req_text) FROM ({CAPTURE_SQL}))").replace(
    "strlen(req_text), true,", "strlen(req_text), false,"
)

_ZONED = (
    "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN strftime(ts, '%f') <> '000000' "
    "THEN strftime(ts, '.%f') ELSE '' END, '+00:00')"
)
_SEARCH_TERMS = f"""SELECT id, {_ZONED} AS ts, method, status, host, path, url, tags AS tech FROM flows"""
_HAY = "lower(host || path)"

_DETAIL_JOIN = """flows LEFT JOIN bodies qb ON qb.sha256 = flows.req_body_sha
  LEFT JOIN bodies rb ON rb.sha256 = flows.resp_body_sha"""


def _kind(side: str, text: str) -> str:
    b = "qb" if side == "req" else "rb"
    return f"""CASE WHEN coalesce({b}.size, 0) = 0 THEN 'empty' WHEN {b}.is_text THEN 'text' ELSE 'binary' END AS {side}_kind,
  nullif({b}.size, 0) AS {side}_size, CASE WHEN {b}.size > 0 AND {b}.is_text THEN md5({text}) END AS {side}_text_md5"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "bodies_dedup": f"{_BASE} SELECT sha256, size, is_text, ever_text, seen_count, first_seen, length(content) AS n_chars FROM bodies",
        "body_text_index": f"{_BASE} SELECT sha256, len(tokens) AS n_tokens, md5(array_to_string(list_sort(tokens), ' ')) AS tokens_md5 FROM words",
        "stored_bodies": f"{_BASE} SELECT sha256, size, is_text, seen_count, first_seen, length(content) AS n_chars FROM bodies",
        "flow_agg_rollup": _SHAPES,
        "stored_flow_agg": _SHAPES,
        "collapse_routing": f"{_BASE} SELECT {_SHAPE_KEY} AS shape_sha, count(*) AS hit_count, count(*) FILTER (WHERE method <> 'POST') AS stored_flows FROM fl GROUP BY shape_sha",
        "archive_rebuild": f"{_BASE} SELECT {_SHAPE_KEY} AS shape_sha, count(*) AS hit_count FROM fl WHERE method <> 'POST' GROUP BY shape_sha",
        "archive_retag": _select("id, tags", flows=_tagged(a=_PAGED)),
        "archive_retag_new": f"""{_tagged(a=_PAGED)} SELECT id, CASE WHEN id <= m THEN 0 ELSE 1 END AS batch_id,
            CASE WHEN id > m OR len(base_tags) = 0 THEN tags ELSE array_to_string(base_tags, ',') END AS tags
            FROM flows, (SELECT max(id) / 2 AS m FROM flows)""",
        "schema_growth": f"""{_FLOWS} SELECT id, CASE WHEN id > m THEN concat('seen ', method) END AS note, tags
            FROM flows, (SELECT max(id) / 2 AS m FROM flows)""",
        "archive_counts": "SELECT count(*) AS written, 0 AS rejected FROM events",
        "search_all": _select(f"id, {_ZONED} AS ts, host", "WHERE contains(lower(host), 'example') OR contains(lower(url), 'example')"),
        "fingerprint_all": _select("id, tags"),
        "fingerprint_untagged": _select("id, tags", "WHERE len(base_tags) = 0", _tagged(a=_PAGED)),
        "user_rule": _select("id, tags", flows=_tagged(a=_PAGED, b=_LICENSE)),
        "python_rule": _select("id, tags", flows=_tagged(a=_SHORT)),
        "tech_facets": f"{_FLOWS} SELECT tech, count(*) AS n FROM (SELECT unnest(tag_list) AS tech FROM flows) GROUP BY tech ORDER BY n DESC, tech LIMIT 30",
        "top_tech": f"{_FLOWS} SELECT tech, count(*) AS n FROM (SELECT unnest(tag_list) AS tech FROM flows) GROUP BY tech ORDER BY n DESC, tech LIMIT 15",
        "corpus_stats": f"""{_BASE} SELECT (SELECT count(*) FROM fl) AS flows, count(*) AS unique_bodies,
            CAST(coalesce(sum(seen_count), 0) AS BIGINT) AS body_occurrences,
            CAST(round_even(sum(seen_count) / count(*), 1) AS DOUBLE) AS dedup_ratio,
            CAST(coalesce(sum(size), 0) AS BIGINT) AS unique_bytes,
            CAST(coalesce(sum(size * seen_count), 0) AS BIGINT) AS observed_bytes FROM bodies""",
        "search_tech": _found("list_has_all(tag_list, ['nginx', 'apigee'])"),
        "search_host": _found("host ILIKE '%BLOG.%'"),
        "search_host_pattern": _found("host ILIKE '%th_r%org%'", None),
        "search_host_literal": _found("contains(host, 'example.o')", None),
        "search_status": _found("status = 403"),
        "search_method": _found("method = 'POST'"),
        "search_program": _found("program = 'prog-3'"),
        "search_session": _found("session_id = 's-8'"),
        "search_since": _found("ts >= TIMESTAMP '2024-01-20 12:00:00'", None),
        "search_grep": _found(f"resp_body_sha IN {_hits('access', 'denied', 'the')}"),
        "search_grep_all": _found(f"resp_body_sha IN {_hits('errors', 'graphql')}", None),
        "search_body_any": _found(f"resp_body_sha IN {_hits('k')} OR req_body_sha IN {_hits('k')}", None),
        "search_combined": _found(
            "list_contains(tag_list, 'waf-generic') AND (host ILIKE '%example%' OR url ILIKE '%example%')"
            f" AND (resp_body_sha IN {_hits('denied')} OR req_body_sha IN {_hits('denied')})"
            " AND program = 'prog-1' AND ts >= TIMESTAMP '2024-01-05'",
            None,
        ),
        "search_terms": f"{_FLOWS} {_SEARCH_TERMS} WHERE (host ILIKE '%blog%' OR url ILIKE '%blog%') AND (host ILIKE '%page=2%' OR url ILIKE '%page=2%') {_NEWEST} LIMIT 300",
        "search_by_id": f"{_FLOWS} {_SEARCH_TERMS} WHERE id = 424",
        "search_ranked": f"""{_FLOWS}, newest AS (SELECT {_SUMMARY}, path FROM flows
            WHERE (host ILIKE '%th%' OR url ILIKE '%th%') AND (host ILIKE '%page%' OR url ILIKE '%page%') {_NEWEST} LIMIT 300)
            SELECT *, {_score(_HAY, 'th', 'page')} AS score FROM newest""",
        "live_tail": _select(_SUMMARY.replace("tags AS", "array_to_string(tag_list[1:3], ',') AS"), f"{_NEWEST} LIMIT 50"),
        "match_offsets": _select(f"id, {_offsets(_HAY, 'th', 'en/')} AS offsets"),
        "relevance_scores": _select(f"id, {_score(_HAY, 'th', 'blog')} AS score"),
        "flow_request": _select(f"id, ts, method, scheme, host, port, path, query, url, status, {_REQ_HEADERS} AS req_headers, req_body_sha"),
        "flow_full": f"""{_FLOWS} SELECT id, ts, program, source_tool, session_id, method, scheme, host, port, path, query, url,
            status, duration_ms, tags, {_REQ_HEADERS} AS req_headers, {_RESP_HEADERS} AS resp_headers, req_body_sha,
            qb.is_text AS req_is_text, resp_body_sha, rb.is_text AS resp_is_text FROM {_DETAIL_JOIN}""",
        "flow_detail": f"""{_FLOWS} SELECT id, {_ZONED} AS ts, program, session_id, method, host, path, query, url, status,
            duration_ms, tags, {_RESP_HEADERS} AS resp_headers, {_kind('req', 'req_text')}, {_kind('resp', 'resp_text')} FROM {_DETAIL_JOIN}""",
        "flow_listing": _select(
            "id, printf('#%-8d %s %3s %-6s [%s] %s', id, strftime(ts, '%Y-%m-%d %H:%M'),"
            " coalesce(CAST(status AS VARCHAR), 'None'), method, CASE WHEN tags = '' THEN '-' ELSE tags END, url) AS line"
        ),
        "curl_export": _select(f"id, {_CURL} AS curl"),
        "raw_request": _select(
            "id, concat(method, ' ', path, coalesce('?' || query, ''), ' HTTP/2', chr(10), 'host: ', host, chr(10),"
            " 'Accept: */*', chr(10), 'Cookie: sid=''', session_id, '''',"
            " CASE WHEN req_text IS NOT NULL THEN concat(chr(10), 'Content-Type: application/json', chr(10),"
            " 'Content-Length: ', length(req_text), chr(10), chr(10), req_text) ELSE '' END) AS request"
        ),
        "body_preview": f"""{_FLOWS} SELECT id,
            concat('HTTP/1.1 ', coalesce(CAST(status AS VARCHAR), 'None'), ' ', CASE status WHEN 200 THEN 'OK'
              WHEN 403 THEN 'Forbidden' WHEN 406 THEN 'Not Acceptable' WHEN 500 THEN 'Internal Server Error' ELSE '' END) AS status_line,
            CASE WHEN req_text IS NULL THEN '(no body)' ELSE regexp_replace(req_text, '^\\{{(.*)\\}}$', '{{' || chr(10) || '  \\1' || chr(10) || '}}') END AS req_preview,
            md5(CASE WHEN coalesce(resp_text, '') = '' THEN '(no body)' WHEN NOT rb.is_text THEN '<binary, ' || rb.size || ' bytes>'
              WHEN length(resp_text) > 4000 THEN substring(resp_text, 1, 4000) || chr(10) || '... [truncated, ' || rb.size || ' bytes total]'
              ELSE resp_text END) AS resp_preview FROM {_DETAIL_JOIN}""",
        "request_variants": _select(
            "id AS replay_of, 'PUT' AS method, 'http' AS scheme, 'staging.example.com' AS host, 8080 AS port, '/v2' AS path,"
            " 'id=' || id AS query, 'http://Staging.Example.com:8080/v2?id=' || id AS url,"
            " concat('Host=', host, ';accept=text/html;X-Replay=1;Content-Type=application/json;Content-Length=', length(req_text)) AS req_headers,"
            " '{}' AS req_body",
            "WHERE method = 'POST'",
        ),
        "request_matrix": " UNION ALL ".join(f"({part})" for part in (
            _select(
                "id AS replay_of, 'plain' AS template, method, 'http' AS scheme, host, 8080 AS port, path, query,"
                " concat('http://', host, ':8080', path, coalesce('?' || query, '')) AS url,"
                f" regexp_replace({_REQ_HEADERS}, ';Cookie=sid=''[^'']*''', '') AS req_headers, req_text AS req_body"
            ),
            _select(
                "id, 'method', 'OPTIONS', scheme, host, port, path, query, url,"
                " concat('Host=', host, ';ACCEPT=text/html;Cookie=sid=''', session_id, ''';X-Probe=1',"
                " CASE WHEN req_text IS NOT NULL THEN concat(';Content-Type=application/json;Content-Length=', length(req_text)) ELSE '' END),"
                " req_text"
            ),
            _select(
                "id, 'empty', method, 'https', 'probe.example.com', NULL, '/' || id, NULL,"
                f" 'https://probe.example.com/' || id, {_REQ_HEADERS}, '[]'"
            ),
        )),
        "stored_replays": f"""{_FLOWS} SELECT 'request-' || id AS key, id AS replay_of, status AS parent_status, 200 AS status,
            status IS DISTINCT FROM 200 AS status_changed, false AS body_changed, 5 AS duration_change_ms FROM flows WHERE method = 'POST'""",
        "stream_metrics": f"""WITH cap AS ({CAPTURE_SQL}) SELECT
            CAST(count(*) FILTER (coalesce(status, 0) NOT IN (403, 406, 419, 500)) AS BIGINT) AS written,
            CAST(count(*) FILTER (status IN (403, 406)) AS BIGINT) AS rejected FROM cap""",
        "sendable_headers": _select(f"id, regexp_replace({_REQ_HEADERS}, ';Content-Length=.*$', '') AS req_headers"),
        "replay_pairs": f"""{_FLOWS} SELECT c.id, c.replay_of, p.status AS parent_status, c.status,
            c.status IS DISTINCT FROM p.status AS status_changed,
            c.resp_body_sha IS DISTINCT FROM p.resp_body_sha AS body_changed,
            c.duration_ms - p.duration_ms AS duration_change_ms FROM flows c JOIN flows p ON p.id = c.replay_of""",
        "replay_chain": f"""WITH RECURSIVE e AS (SELECT id, replay_of FROM ({CAPTURE_SQL}) WHERE replay_of IS NOT NULL),
            chain AS (SELECT id, replay_of AS root, 1 AS depth FROM e WHERE replay_of NOT IN (SELECT id FROM e)
              UNION ALL SELECT e.id, c.root, c.depth + 1 FROM e JOIN chain c ON e.replay_of = c.id)
            SELECT id, root, CAST(depth AS BIGINT) AS depth FROM chain""",
        "hosts_by_tech": f"{_FLOWS} SELECT tech, host, count(*) AS n_flows, max(ts) AS last_seen FROM (SELECT host, ts, unnest(tag_list) AS tech FROM flows) GROUP BY tech, host",
        "top_shapes": f"SELECT * FROM ({_SHAPES}) WHERE host = (SELECT host FROM ({_FLOWS} SELECT host FROM flows) GROUP BY host ORDER BY count(*) DESC, host LIMIT 1) ORDER BY hit_count DESC, last_seen DESC, shape_sha LIMIT 20",
        "url_parts": f"SELECT page_id, scheme, nullif(host, '') AS host, port, raw_path AS path, query FROM (SELECT page_id, {_URL} FROM pages)",
        "parse_jsonl": f"""{_LINES} SELECT ts, method, scheme, host, port, path, query, url, status,
            regexp_replace({_REQ_HEADERS}, '^Host=[^;]*;', '') AS req_headers, {_RESP_HEADERS_TYPED} AS resp_headers,
            'p' AS program, 's' AS session_id, 'proxify' AS source_tool, '' AS req_content_type,
            content_type AS resp_content_type, req_body_sha, resp_body_sha FROM fl""",
        "dead_letters": f"""WITH cap AS ({CAPTURE_SQL}) SELECT 'jsonl' AS source,
            CASE status WHEN 403 THEN 'bad_json' WHEN 406 THEN 'not_a_record' ELSE 'kept' END AS reason,
            {_ISO.format('cap.ts')} || 'Z' AS seen_at FROM cap WHERE coalesce(status, 0) NOT IN (419, 500)""",
        "normalise_capture": f"""{_BASE}, clocks AS (SELECT *, epoch_us(ts) / 1e6 AS t0, epoch_us(ts) / 1e6 + duration_ms / 1000.0::DOUBLE AS t1 FROM fl)
            SELECT id, ts, method, scheme, host, port, path, query, url, status,
            CASE WHEN status IS NOT NULL THEN CAST(trunc((t1 - t0) * 1000) AS INT) END AS duration_ms,
            {_REQ_HEADERS} AS req_headers, CASE WHEN status IS NULL THEN '' ELSE {_RESP_HEADERS} END AS resp_headers,
            'p' AS program, 's' AS session_id, 'mitm' AS source_tool, true AS collapse,
            CASE WHEN req_text IS NOT NULL THEN 'application/json' ELSE '' END AS req_content_type, '' AS resp_content_type,
            req_body_sha, CASE WHEN status IS NOT NULL THEN resp_body_sha END AS resp_body_sha FROM clocks""",
        "stream_rollup": f"{_LINES} {_shape_table(chr(39) + 'streamed' + chr(39), chr(39) + 'proxify' + chr(39))} FROM fl GROUP BY shape_sha",
        "stream_bodies": f"""{_LINES} SELECT b.sha256, size, seen_count, first_seen, len(tokens) AS n_tokens, length(content) AS n_chars
            FROM bodies b LEFT JOIN words w ON w.sha256 = b.sha256""",
        "stream_body_types": f"{_LINES} SELECT sha256, is_text, ever_text FROM bodies",
        "stream_tag_new": _select(
            "ts, url, status, array_to_string(list_filter(tag_list, lambda t: t NOT IN ('apigee', 'graphql', 'waf-generic')), ',') AS tags"
        ),
        "stream_tag_all": _select("ts, url, status, tags"),
    }
    sql |= {
        "stream_state_rollup": sql["stream_rollup"],
        "stream_state_bodies": f"{_LINES} SELECT sha256, size, seen_count, first_seen FROM bodies",
        "stream_new_keys": f"{_LINES} SELECT sha256, size, 1 AS named FROM bodies",
    }
    return sql | {"tail_jsonl": sql["parse_jsonl"]}
