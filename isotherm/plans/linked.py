"""SQL of the links by similarity: every window of a text against every name, nothing indexed or skipped."""

from isotherm.plans import oracle as o


def linked_sql(
    threshold: float, exact_single: bool = True, aliases: dict | None = None, source: str = "questions", measure: str = "levenshtein"
) -> str:
    """CTE ``lk(qid, kind, name)``: names that a text of ``source`` holds exactly, by alias, or nearly.

    Windows have as many words as the name. ``win`` has the distinct windows, ``sm`` the similar pairs with their similarity.
    """
    known = ", ".join(f"('{a}', '{c}')" for a, c in (aliases or {"-": "-"}).items())
    single = "k > 1" if exact_single else "k > 0"
    pairs = f"(SELECT DISTINCT phrase, k FROM win) w JOIN (SELECT DISTINCT np, k FROM nw WHERE {single}) USING (k)"
    if measure == "ratio":
        # Equal blocks are a common subsequence, so no more edits than the unmatched characters are needed.
        similar = f"""cand AS (SELECT np, phrase AS p FROM {pairs} WHERE levenshtein(phrase, np) <= {1 - threshold:.9f} * (length(phrase) + length(np)) + 1e-9),
  {o.RATIOS}, sm AS (SELECT p AS phrase, np, similarity FROM ratios WHERE similarity >= {threshold})"""
    else:
        score = "1 - levenshtein(phrase, np) / greatest(length(phrase), length(np))"
        similar = f"sm AS (SELECT phrase, np, {score} AS similarity FROM {pairs} WHERE {score} >= {threshold})"
    return f""", nq AS (SELECT qid, {o.norm('text')} AS n FROM {source}),
    dn AS (SELECT DISTINCT n FROM nq), tk AS (SELECT n, list_filter(string_split(n, ' '), lambda x: x <> '') AS t FROM dn),
    ps AS (SELECT n, t, unnest(generate_series(1, len(t))) AS i FROM tk), nw AS (SELECT kind, name, phrase AS np, len(string_split(phrase, ' ')) AS k FROM names),
    al(a, full_name) AS (VALUES {known}),
    win AS (SELECT n, array_to_string(t[i:i + k - 1], ' ') AS phrase, k FROM ps, (SELECT DISTINCT k FROM nw) WHERE i + k - 1 <= len(t)
      UNION SELECT n, full_name, len(string_split(full_name, ' ')) FROM tk JOIN al ON contains(' ' || n || ' ', ' ' || a || ' ')),
    {similar},
    lp AS (SELECT DISTINCT phrase, kind, name FROM win JOIN nw USING (k) WHERE phrase = np UNION SELECT phrase, kind, name FROM sm JOIN nw USING (np)),
    lk AS (SELECT DISTINCT qid, kind, name FROM nq JOIN win USING (n) JOIN lp USING (phrase))"""
