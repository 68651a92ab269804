"""DuckDB SQL that gives the rows of corpus queries, in plain joins over whole texts."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"


def _crc32(of: str) -> str:
    """crc32 of a number as text, bit by bit."""
    codes = f"list_transform(string_split(CAST({of} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda s, i: xor(s >> 1, CASE WHEN s % 2 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), 4294967295)"


EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_SPACED} AS w FROM documents),
placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
runs AS (
    SELECT doc_id, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) AS g, i,
           count(*) OVER (PARTITION BY doc_id) AS n
    FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
shingles AS (SELECT DISTINCT doc_id, g FROM runs WHERE i <= greatest(n - 4, 1)),
sets AS (SELECT doc_id, count(g) AS size FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
    SELECT u, v FROM common JOIN sets x ON x.doc_id = u JOIN sets y ON y.doc_id = v
    WHERE 100 * n >= 75 * (x.size + y.size - n)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, v FROM reach r JOIN links ON other = u),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, size AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

LICENSE_PHRASES = f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
phrases AS (
    SELECT string_split(phrase, ' ') AS p, label
    FROM (VALUES ('cc by', 'cc-by'), ('general public license', 'gpl'), ('all rights reserved', 'reserved')) v(phrase, label)),
hits AS (SELECT doc_id, i - 1 AS place, label FROM placed JOIN phrases ON w[i] = p[1] AND w[i:i + len(p) - 1] = p)
SELECT doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM words LEFT JOIN hits USING (doc_id) GROUP BY doc_id
"""

#: Good-Turing discounts hold for counts of 1 to 5; the end of a text is the word ''.
KATZ = f"""
WITH texts AS (SELECT doc_id, {_crc32("doc_id")} % 7 <> 2 AS training, list_append({_SPACED}, '') AS w FROM documents),
placed AS (SELECT doc_id, training, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
tokens AS (SELECT doc_id, training, w[i] AS word, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS context FROM placed),
known AS (SELECT word, count(*) AS c FROM tokens WHERE training GROUP BY word),
totals AS (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c) AS DOUBLE) + count(*) + 1 AS size FROM known),
pairs AS (SELECT context, word, count(*) AS k FROM tokens WHERE training GROUP BY context, word),
counts AS (SELECT r, CAST((SELECT count(*) FROM pairs WHERE k = r) AS DOUBLE) AS m FROM range(1, 7) t(r)),
ratios AS (
    SELECT a.r, a.m, b.m AS next, 6 * (SELECT m FROM counts WHERE r = 6) / (SELECT m FROM counts WHERE r = 1) AS rest
    FROM counts a JOIN counts b ON b.r = a.r + 1),
turing AS (SELECT r, CASE WHEN m > 0 AND next > 0 AND rest < 1 THEN ((r + 1) * next / m / r - rest) / (1 - rest) END AS d FROM ratios),
discounts AS (SELECT r, CASE WHEN d > 0 AND d < 1 THEN d ELSE (r - 0.5) / r END AS d FROM turing),
discounted AS (
    SELECT context, word, k, k * coalesce(d, 1) AS kept, (c + 1) / size AS share
    FROM pairs JOIN known USING (word) LEFT JOIN discounts ON r = k CROSS JOIN totals),
sums AS (SELECT context, sum(k) AS total, sum(kept) AS kept, sum(share) AS seen FROM discounted GROUP BY context),
bases AS (SELECT context, kept, seen, CASE WHEN total - kept < 1e-9 THEN total + 1 ELSE total END AS base FROM sums),
parts AS (
    SELECT doc_id, coalesce(c, 0) AS c, n, log10((coalesce(c, 0) + 1) / size) AS plain,
           CASE WHEN p.k IS NOT NULL THEN log10(p.kept / b.base)
                WHEN b.context IS NOT NULL THEN log10((1 - b.kept / b.base) / (1 - b.seen) * (coalesce(c, 0) + 1) / size)
                ELSE log10((coalesce(c, 0) + 1) / size) END AS backed
    FROM tokens t CROSS JOIN totals LEFT JOIN known USING (word)
    LEFT JOIN discounted p ON p.context = t.context AND p.word = t.word LEFT JOIN bases b ON b.context = t.context)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens,
       round(sum(plain), 4) AS base_score, round(sum(backed), 4) AS score
FROM parts GROUP BY doc_id
"""

DECODED = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"


def _repair() -> str:
    """The forward pass turn by turn; a path is its cost in nine digits, its audit string, and the repaired text."""

    def path(before: str, cost: str, letter: str, said: str | None, first: bool) -> str:
        text = f"{before}.t" if said is None else said if first else f"concat({before}.t, chr(10), {said})"
        return f"{{'k': concat(lpad(CAST(CAST(left({before}.k, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0'), substr({before}.k, 10), '{letter}'), 't': {text}}}"

    def layer(state: str, initial: str, name: str, before: list[str]) -> str:
        """The least path into a state: the turn deleted, kept or given another role."""
        kept = "concat(j.role, ':', j.text)"
        options = [path(f"w.{state}", "2", "D", None, False)]
        for b in before:
            options.append(f"CASE WHEN j.stays AND left(j.role, 1) = '{initial}' THEN {path(f'w.{b}', 'j.more', 'K', kept, b == 'z')} END")
            if name:
                given = f"concat('{name}:', j.text)"
                options.append(f"CASE WHEN j.stays THEN {path(f'w.{b}', '1 + j.more', 'R', given, b == 'z')} END")
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL)) AS {state}"

    layers = ", ".join([layer("z", "", "", []), layer("s", "s", "", ["z"]), layer("u", "u", "user", ["z", "s", "a"]), layer("a", "a", "assistant", ["u"])])
    into_u = f"list_min([u, {path('z', '5', 'I', chr(39) + 'user:' + chr(39), True)}, {path('s', '5', 'I', chr(39) + 'user:' + chr(39), False)}, {path('a', '5', 'I', chr(39) + 'user:' + chr(39), False)}])"
    into_a = f"list_min([a, {path('u', '5', 'I', chr(39) + 'assistant:' + chr(39), False)}])"
    none = "{'k': '900000000', 't': ''}"
    closed = lambda inside: f"SELECT conv_id, i, z, s, u, {into_a} AS a FROM (SELECT conv_id, i, z, s, {into_u} AS u, a FROM ({inside}))"
    key = "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"
    return f"""
WITH RECURSIVE marked AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(key)} % 20 AS fault FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM marked),
seen AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS copies FROM damaged),
placed AS (
    SELECT *, row_number() OVER turns AS i, lag(left(role, 1)) OVER turns AS earlier
    FROM seen WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copies)),
judged AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN copies > 1 THEN 'd'
                   WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault
    FROM placed),
turns AS (
    SELECT conv_id, i, role, text, fault NOT IN ('b', 'd') AS stays, CASE fault WHEN 't' THEN 5 ELSE 0 END AS more FROM judged),
walk AS (
    {closed(f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'k': '000000000', 't': ''}} AS z, {none} AS s, {none} AS u, {none} AS a FROM conversations")}
    UNION ALL
    {closed(f"SELECT w.conv_id, j.i, {layers} FROM walk w JOIN turns j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1")}),
ends AS (
    SELECT conv_id, list_min([z, a]) AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
           count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (earlier IS NOT NULL AND concat(earlier, left(role, 1)) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(left(best.k, 9) AS BIGINT) AS cost,
       substr(best.k, 10) AS audit, sha256(best.t) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


REPAIR = _repair()
