"""DuckDB SQL for the queries; parts are named once and joined into WITH lists."""

from __future__ import annotations

_BYTE = "greatest(0, least(255, floor(({}::DOUBLE + 0.6) * 200)))::BIGINT"
_GRAY = f"gray AS (SELECT frame, k, {_BYTE.format('e')} AS r, r AS g, r AS b FROM (SELECT vec_id AS frame, unnest(embedding) AS e, unnest(generate_series(0, 63)) AS k FROM embeddings))"
_RGB = "rgb AS (SELECT vec_id AS frame, k, {} AS r, {} AS g, {} AS b FROM embeddings, (SELECT unnest(generate_series(0, 20)) AS k))".format(*(_BYTE.format(f"embedding[3 * k + {c}]") for c in (1, 2, 3)))


def _hsv(pixels: str) -> str:
    return f"""
    raw AS (SELECT frame, k, r, g, b, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM {pixels}),
    turn AS (SELECT frame, k, v, d, CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END AS t FROM raw),
    scaled AS (SELECT frame, k, v, d, CASE WHEN d = 0 THEN 0 ELSE floor((d * round_even(1044480.0::DOUBLE / v, 0) + 2048) / 4096)::BIGINT END AS s,
      CASE WHEN d = 0 THEN 0 ELSE floor((t * round_even(737280.0::DOUBLE / (6.0::DOUBLE * d), 0) + 2048) / 4096)::BIGINT END AS h FROM turn),
    hsv AS (SELECT frame, k, CASE WHEN h < 0 THEN h + 180 WHEN h >= 180 THEN h - 180 ELSE h END AS h, greatest(0, least(255, s)) AS s, v FROM scaled)"""


_DELTA = """
    ord AS (SELECT frame, lag(frame) OVER (ORDER BY frame) AS prev FROM (SELECT DISTINCT frame FROM hsv)),
    delta AS (SELECT o.frame, coalesce(sum(abs(a.h - b.h)), 0)::DOUBLE AS dh, coalesce(sum(abs(a.s - b.s)), 0)::DOUBLE AS ds, coalesce(sum(abs(a.v - b.v)), 0)::DOUBLE AS dv, greatest(count(b.k), 1)::DOUBLE AS n
      FROM ord o JOIN hsv a ON a.frame = o.frame LEFT JOIN hsv b ON b.frame = o.prev AND b.k = a.k GROUP BY o.frame)"""
_COLOR = f"{_RGB}, {_hsv('rgb')}, {_DELTA}"
_CONTENT = f"{_GRAY}, {_hsv('gray')}, {_DELTA}, score AS (SELECT frame, (dh + ds + dv) / (n * 3) AS score FROM delta), total AS (SELECT count(*) AS total FROM ord)"
_LUMA = "0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b"
_CUTS = """
    over_ AS (SELECT frame, frame - lag(frame, 1, 0) OVER (ORDER BY frame) >= 3 AS ok FROM score WHERE score >= 10 AND frame > (SELECT min(frame) FROM score)),
    cuts AS (SELECT frame FROM over_ WHERE ok)"""


def _spans(boundaries: str, total: str = "total") -> str:
    """spans over one video."""
    return f"starts AS (SELECT DISTINCT start FROM (SELECT frame AS start FROM {boundaries} UNION ALL SELECT 0) WHERE (SELECT total FROM {total}) > 0), spans AS (SELECT 0::BIGINT AS video_id, row_number() OVER (ORDER BY start)::INT AS scene_number, start, lead(start, 1, (SELECT total FROM {total})) OVER (ORDER BY start) AS \"end\" FROM starts)"


def _video_spans(boundaries: str, name: str = "spans") -> str:
    return f"{name}_s AS (SELECT DISTINCT video_id, start FROM (SELECT video_id, frame AS start FROM {boundaries} UNION ALL SELECT video_id, 0 FROM totals)), {name} AS (SELECT s.video_id, row_number() OVER w::INT AS scene_number, start, coalesce(lead(start) OVER w, total) AS \"end\" FROM {name}_s s JOIN totals USING (video_id) WINDOW w AS (PARTITION BY s.video_id ORDER BY start))"


_STREAM = "stream AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, value AS x, ts FROM events), totals AS (SELECT video_id, count(*) AS total FROM stream GROUP BY video_id)"
_RATIO = f"""{_STREAM}, ratio AS (SELECT video_id, frame, x, CASE WHEN count(x) OVER b = 2 AND count(x) OVER a = 2 THEN x / ((sum(x) OVER b + sum(x) OVER a) / 4.0::DOUBLE + 1e-6::DOUBLE) ELSE 0 END AS r FROM stream
      WINDOW b AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))"""


def _greedy(name: str, source: str, m: int, video: str = "video_id") -> str:
    """name (video, frame): candidates of source that lie m or more after the last accepted one."""
    return f"""{name}_n AS (SELECT c.{video}, c.frame, (SELECT min(e.frame) FROM {source} e WHERE e.{video} = c.{video} AND e.frame >= c.frame + {m}) AS next FROM {source} c),
    {name} AS (SELECT {video}, min(frame) AS frame FROM {source} WHERE frame >= {m} GROUP BY {video} UNION ALL SELECT g.{video}, n.next FROM {name} g JOIN {name}_n n ON n.{video} = g.{video} AND n.frame = g.frame WHERE n.next IS NOT NULL)"""


def _adaptive(name: str, threshold: float) -> str:
    return f"{name}_c AS (SELECT video_id, frame FROM ratio WHERE x >= 15 AND r >= {threshold}), {_greedy(name, name + '_c', 5)}"


_HIST = f"""{_GRAY}, bins AS (SELECT frame, greatest(0, least(15, floor(({_LUMA}) * 16 / 256.0::DOUBLE)))::INT AS bin FROM gray),
    counts AS (SELECT f.frame, k.bin, count(b.bin)::DOUBLE AS c FROM (SELECT DISTINCT frame FROM gray) f CROSS JOIN (SELECT unnest(generate_series(0, 15))::INT AS bin) k LEFT JOIN bins b ON b.frame = f.frame AND b.bin = k.bin GROUP BY f.frame, k.bin),
    hist AS (SELECT frame, bin, c / sqrt(sum(c * c) OVER (PARTITION BY frame)) AS x FROM counts)"""
_CORR = f"""{_HIST}, ord AS (SELECT frame, lag(frame) OVER (ORDER BY frame) AS prev FROM (SELECT DISTINCT frame FROM hist)),
    centred AS (SELECT frame, bin, x - avg(x) OVER (PARTITION BY frame) AS x FROM hist),
    corr_ AS (SELECT o.frame, CASE WHEN o.prev IS NULL THEN 0 ELSE coalesce(sum(a.x * b.x) / nullif(sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 0), 1) END AS x, o.prev IS NULL AS first FROM ord o JOIN centred a ON a.frame = o.frame LEFT JOIN centred b ON b.frame = o.prev AND b.bin = a.bin GROUP BY o.frame, o.prev)"""
_FADES = f"""{_STREAM}, marked AS (SELECT video_id, frame, x < 12 AS dark, lag(x < 12) OVER (PARTITION BY video_id ORDER BY frame) AS before FROM stream),
    turns AS (SELECT video_id, frame, dark, lead(frame) OVER (PARTITION BY video_id ORDER BY frame) AS nxt FROM marked WHERE before IS NULL OR dark <> before),
    fades AS (SELECT video_id, frame AS out, nxt AS back FROM turns WHERE dark)"""
_FADE_CUTS = f"""{_FADES}, fc AS (SELECT video_id, back AS frame FROM fades WHERE back IS NOT NULL), {_greedy('fg', 'fc', 5)},
    cuts AS (SELECT f.video_id, f.out + round_even((f.back - f.out) / 2.0::DOUBLE, 0)::BIGINT AS frame FROM fades f JOIN fg ON fg.video_id = f.video_id AND fg.frame = f.back
      UNION ALL SELECT f.video_id, f.out FROM fades f JOIN totals t USING (video_id) WHERE f.back IS NULL AND t.total - coalesce((SELECT max(frame) FROM fg WHERE fg.video_id = f.video_id), 0) >= 5)"""
_ADAPTIVE_SPANS = f"{_RATIO}, {_adaptive('ga', 3)}, {_video_spans('ga')}"
_FADE_SPANS = f"{_FADE_CUTS}, {_video_spans('cuts')}"
_SIGN = f"{_GRAY}, sign AS (SELECT frame, sum(CASE WHEN r > 112 THEN 1::BIGINT << k ELSE 0 END)::BIGINT AS hash FROM gray WHERE k < 62 GROUP BY frame)"
_BLOCKS = "cuts AS (SELECT frame FROM sign WHERE frame % 5 = 0), total AS (SELECT count(*) AS total FROM sign), " + _spans("cuts")
_MAJORITY = f"""{_SIGN}, {_BLOCKS}, member AS (SELECT scene_number, s.frame, hash FROM spans JOIN sign s ON s.frame >= start AND s.frame < "end"),
    votes AS (SELECT scene_number, k, sum((hash >> k) & 1) AS ones, count(*) AS n, (arg_min(hash, frame) >> k) & 1 AS first FROM member, (SELECT unnest(generate_series(0, 62)) AS k) GROUP BY scene_number, k),
    major AS (SELECT scene_number, sum(CASE WHEN 2 * ones > n OR 2 * ones = n AND first = 1 THEN 1::BIGINT << k ELSE 0 END)::BIGINT AS hash, max(n)::BIGINT AS samples FROM votes GROUP BY scene_number)"""
_RAW = "raw AS (SELECT video_id, start AS frame FROM spans WHERE start > 0)"
_EFFECTIVE = f"""{_ADAPTIVE_SPANS}, {_RAW}, act AS (SELECT video_id, frame, CASE frame % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'accept' ELSE 'manual' END AS action FROM stream WHERE frame % 7 = 0),
    eff AS (SELECT DISTINCT video_id, frame FROM (SELECT video_id, frame FROM raw WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.video_id = raw.video_id AND act.frame = raw.frame AND action = 'reject') UNION ALL SELECT video_id, frame FROM act WHERE action <> 'reject') JOIN totals USING (video_id) WHERE frame > 0 AND frame < total)"""
_MATCH = f"""{_RATIO}, {_adaptive('ga', 3)}, {_adaptive('gb', 4)}, found AS (SELECT coalesce(ga.video_id, gb.video_id)::VARCHAR AS case_id, CASE WHEN gb.frame IS NULL THEN 'false_negative' WHEN ga.frame IS NULL THEN 'false_positive' ELSE 'match' END AS kind, coalesce(ga.frame, gb.frame) AS frame FROM ga FULL JOIN gb ON ga.video_id = gb.video_id AND ga.frame = gb.frame)"""
_MEDIA = "media AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample, round(epoch_us(ts)::DOUBLE * 1 / 1000000 - min(epoch_us(ts)::DOUBLE * 1 / 1000000) OVER (PARTITION BY user_id), 3) AS t FROM events)"
_REVIEW = f"""{_CONTENT}, {_CUTS}, {_spans('cuts')}, seeds AS (SELECT s.frame, s.score, CASE WHEN o.ok THEN 'accepted' WHEN NOT o.ok THEN 'suppressed_min_scene_len' ELSE 'near_miss' END AS status FROM score s LEFT JOIN over_ o ON o.frame = s.frame WHERE s.score >= 9.5)"""

# Low DCT frequencies of an 8 x 8 luma plane against their median: 4 x 4 of 8 x 8 cells for bits, 8 x 8 of 32 x 32 samples for prints.
_PHASH = f"""{_GRAY}, coef AS (SELECT u, x, cos(pi() * (2 * x + 1) * u / 16) * CASE WHEN u = 0 THEN sqrt(1 / 8.0::DOUBLE) ELSE sqrt(2 / 8.0::DOUBLE) END AS c FROM (SELECT unnest(generate_series(0, 3)) AS u), (SELECT unnest(generate_series(0, 7)) AS x)),
    plane AS (SELECT frame, k // 8 AS y, k % 8 AS x, l / greatest(1, max(l) OVER (PARTITION BY frame)) AS s FROM (SELECT frame, k, {_LUMA} AS l FROM gray)),
    low AS (SELECT frame, a.u * 4 + b.u AS k, sum(a.c * s * b.c) AS x FROM plane JOIN coef a ON a.x = plane.y JOIN coef b ON b.x = plane.x GROUP BY ALL),
    bits AS (SELECT frame, k, x > median(x) OVER (PARTITION BY frame) AS bit FROM (SELECT frame, k, CASE WHEN abs(x) < 1e-12 THEN 0 ELSE x END AS x FROM low))"""
_PAIRS = f"""{_STREAM}, sets AS (SELECT video_id, coalesce(list(frame ORDER BY frame) FILTER (x < 20), []) AS a, coalesce(list(frame ORDER BY frame) FILTER (x >= 20 AND x < 45), []) AS c FROM stream GROUP BY video_id),
    dp AS (SELECT video_id, 0 AS i, list_transform(range(len(c) + 1), lambda k: 0::BIGINT) AS s FROM sets UNION ALL
      SELECT video_id, i, list_transform(range(1, len(b) + 1), lambda j: list_max(b[1:j])) FROM (
        SELECT dp.video_id, i + 1 AS i, list_transform(range(1, len(c) + 2), lambda j: CASE WHEN j > 1 AND abs(a[i + 1] - c[j - 1]) <= 3 THEN greatest(s[j], s[j - 1] + 1000000 - abs(a[i + 1] - c[j - 1])) ELSE s[j] END) AS b
        FROM dp JOIN sets ON sets.video_id = dp.video_id WHERE i < len(a))),
    walk AS (SELECT video_id, len(a)::INT AS i, len(c)::INT AS j, NULL::VARCHAR AS kind, NULL::BIGINT AS rf, NULL::BIGINT AS cf FROM sets UNION ALL
      SELECT video_id, i - (kind <> 'false_positive')::INT, j - (kind <> 'false_negative')::INT, kind, CASE WHEN kind <> 'false_positive' THEN a[i] END, CASE WHEN kind <> 'false_negative' THEN c[j] END FROM (
        SELECT w.video_id, w.i, w.j, a, c, CASE WHEN w.i > 0 AND w.j > 0 AND abs(a[w.i] - c[w.j]) <= 3 AND now.s[w.j + 1] = up.s[w.j] + 1000000 - abs(a[w.i] - c[w.j]) THEN 'match'
          WHEN w.i > 0 AND (w.j = 0 OR up.s[w.j + 1] = now.s[w.j + 1]) THEN 'false_negative' ELSE 'false_positive' END AS kind
        FROM walk w JOIN sets ON sets.video_id = w.video_id JOIN dp now ON now.video_id = w.video_id AND now.i = w.i LEFT JOIN dp up ON up.video_id = w.video_id AND up.i = w.i - 1 WHERE w.i > 0 OR w.j > 0))"""

# Frames of 8 x 8 areas: 320 x 180 by the areas' sizes, 20 x 12 pixel by pixel, where cells of 8 x 8 overlap.
_WIDE = "wide AS (SELECT vec_id AS frame, k, {} AS r, {} AS g, {} AS b FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS k))".format(*(_BYTE.format(f"embedding[(k + {c}) % 64 + 1]") for c in range(3)))
_AREA = "area AS (SELECT y * 8 + x AS k, rows * columns AS n FROM (SELECT i * 8 // 180 AS y, count(*) AS rows FROM range(180) t(i) GROUP BY 1), (SELECT i * 8 // 320 AS x, count(*) AS columns FROM range(320) t(i) GROUP BY 1))"
_WIDE_CONTENT = f"""{_WIDE}, {_AREA}, {_hsv('wide')}, ord AS (SELECT frame, lag(frame) OVER (ORDER BY frame) AS prev FROM (SELECT DISTINCT frame FROM hsv)),
    delta AS (SELECT o.frame, coalesce(sum(n * abs(a.h - b.h)), 0)::DOUBLE / 57600 AS h, coalesce(sum(n * abs(a.s - b.s)), 0)::DOUBLE / 57600 AS s, coalesce(sum(n * abs(a.v - b.v)), 0)::DOUBLE / 57600 AS v
      FROM ord o JOIN hsv a ON a.frame = o.frame JOIN area ON area.k = a.k LEFT JOIN hsv b ON b.frame = o.prev AND b.k = a.k GROUP BY o.frame)"""
_WIDE_FEATURES = f"""{_WIDE}, {_AREA}, mean AS (SELECT frame, sum(n * ({_LUMA})) / 57600 AS m FROM wide JOIN area USING (k) GROUP BY frame),
    bins AS (SELECT frame, least(15, floor(({_LUMA}) * 16 / 256.0::DOUBLE))::INT AS bin, sum(n)::DOUBLE AS c FROM wide JOIN area USING (k) GROUP BY ALL),
    hist AS (SELECT frame, coalesce(sum(c) FILTER (bin = 7), 0) / sqrt(sum(c * c)) AS bin_7, sum(c) / sqrt(sum(c * c)) AS hist_sum FROM bins GROUP BY frame),
    coef AS (SELECT u, x, cos(pi() * (2 * x + 1) * u / 16) * CASE WHEN u = 0 THEN sqrt(1 / 8.0::DOUBLE) ELSE sqrt(2 / 8.0::DOUBLE) END AS c FROM range(4) a(u), range(8) b(x)),
    px AS (SELECT frame, y, x, {_LUMA} AS l FROM range(12) a(y), range(20) b(x), wide WHERE k = (y * 8 // 12) * 8 + x * 8 // 20),
    box AS (SELECT frame, i, j, avg(l) AS l FROM px, range(8) a(i), range(8) b(j) WHERE y >= i * 12 // 8 AND y < (i * 12 + 19) // 8 AND x >= j * 20 // 8 AND x < (j * 20 + 27) // 8 GROUP BY ALL),
    plane AS (SELECT frame, i AS y, j AS x, l / greatest(1, max(l) OVER (PARTITION BY frame)) AS s FROM box),
    low AS (SELECT frame, a.u * 4 + b.u AS k, sum(a.c * s * b.c) AS x FROM plane JOIN coef a ON a.x = plane.y JOIN coef b ON b.x = plane.x GROUP BY ALL),
    bits AS (SELECT frame, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY k) AS bits FROM (SELECT frame, k, x > median(x) OVER (PARTITION BY frame) AS bit FROM (SELECT frame, k, CASE WHEN abs(x) < 1e-12 THEN 0 ELSE x END AS x FROM low)) GROUP BY frame)"""
_HASH_CUTS = f"""{_PHASH}, ord AS (SELECT frame, lag(frame) OVER (ORDER BY frame) AS prev FROM (SELECT DISTINCT frame FROM bits)),
    hc AS (SELECT 0 AS video_id, o.frame FROM ord o JOIN bits a ON a.frame = o.frame JOIN bits b ON b.frame = o.prev AND b.k = a.k GROUP BY o.frame HAVING count(*) FILTER (a.bit <> b.bit) / 16.0::DOUBLE >= 0.625), total AS (SELECT count(*) AS total FROM ord)"""
_PRINT = f"""{_GRAY}, coef AS (SELECT u, x // 4 AS x, sum(cos(pi() * (2 * x + 1) * u / 64) * CASE WHEN u = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE sqrt(2 / 32.0::DOUBLE) END) AS c FROM (SELECT unnest(generate_series(0, 7)) AS u), (SELECT unnest(generate_series(0, 31)) AS x) GROUP BY ALL),
    low AS (SELECT frame, a.u * 8 + b.u AS k, round(sum(a.c * ((77 * r + 150 * g + 29 * b + 128) >> 8) * b.c), 6) AS x FROM gray JOIN coef a ON a.x = gray.k // 8 JOIN coef b ON b.x = gray.k % 8 GROUP BY ALL),
    middle AS (SELECT frame, median(x) AS m FROM low WHERE k > 0 GROUP BY frame)"""


def _around(name: str, dy: int, dx: int, outside: str = "") -> str:
    """The pixel of list name beside (y, x); beyond the frame its nearest one, or outside."""
    inside = f"{name}[1 + greatest(0, least(7, y + {dy})) * 8 + greatest(0, least(7, x + {dx}))]"
    return f"CASE WHEN y + {dy} BETWEEN 0 AND 7 AND x + {dx} BETWEEN 0 AND 7 THEN {inside} ELSE {outside} END" if outside else inside


_GX, _GY = (" - ".join("(" + " + ".join(f"{n} * {_around('p', *at(k, side))}" for k, n in ((-1, 1), (0, 2), (1, 1))) + ")" for side in (1, -1)) for at in (lambda k, side: (k, side), lambda k, side: (side, k)))
_BESIDE = {n: _around("ms", *at, outside="0") for n, at in {"west": (0, -1), "east": (0, 1), "north": (-1, 0), "south": (1, 0), "nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)}.items()}
_PEAK = """CASE WHEN ay < ax * 13573 THEN m > {west} AND m >= {east} WHEN ay > ax * 13573 + ax * 65536 THEN m > {north} AND m >= {south}
      WHEN (gx < 0) = (gy < 0) THEN m > {nw} AND m > {se} ELSE m > {ne} AND m > {sw} END""".format(**_BESIDE)
_EDGES = f"""{_GRAY}, image AS (SELECT frame, list(r ORDER BY k) AS p, floor(greatest(0, median(r) * 2 / 3.0::DOUBLE)) AS low, floor(least(255, median(r) * 4 / 3.0::DOUBLE)) AS high FROM gray GROUP BY frame),
    spot AS (SELECT k, k // 8 AS y, k % 8 AS x FROM (SELECT unnest(generate_series(0, 63)) AS k)),
    slope AS (SELECT frame, k, y, x, low, high, {_GX} AS gx, {_GY} AS gy FROM image, spot),
    steep AS (SELECT *, abs(gx) AS ax, abs(gy) * 32768 AS ay, abs(gx) + abs(gy) AS m FROM slope),
    peaks AS (SELECT frame, y, x, m > low AS weak, m > high AS strong FROM (SELECT s.*, {_PEAK} AS peak FROM steep s JOIN (SELECT frame, list(m ORDER BY k) AS ms FROM steep GROUP BY frame) USING (frame)) WHERE peak),
    edge AS (SELECT frame, y, x FROM peaks WHERE strong UNION SELECT w.frame, w.y, w.x FROM peaks w JOIN edge e ON e.frame = w.frame AND abs(e.y - w.y) <= 1 AND abs(e.x - w.x) <= 1 WHERE w.weak),
    wide AS (SELECT DISTINCT frame, k FROM edge e JOIN spot s ON abs(e.y - s.y) <= 2 AND abs(e.x - s.x) <= 2),
    ord AS (SELECT frame, lag(frame) OVER (ORDER BY frame) AS prev FROM image),
    differ AS (SELECT frame, k FROM (SELECT frame, k FROM wide UNION ALL SELECT o.frame, k FROM wide JOIN ord o ON o.prev = wide.frame) GROUP BY frame, k HAVING count(*) = 1)"""
# Boundaries of one side lie 5 or more apart, so within tolerance 3 only neighbours in the common order match: the best matching of a path, from its end.
_TOLERANT = f"""{_RATIO}, {_adaptive('ga', 3)}, {_adaptive('gb', 4)}, el AS (SELECT video_id::VARCHAR AS case_id, frame, 0 AS side FROM ga UNION ALL SELECT video_id::VARCHAR, frame, 1 FROM gb),
    line AS (SELECT case_id, side, row_number() OVER w AS n, lag(frame) OVER w - frame AS d, coalesce(lag(side) OVER w <> side AND lag(frame) OVER w - frame <= 3, false) AS close FROM el WINDOW w AS (PARTITION BY case_id ORDER BY frame DESC, side DESC)),
    best AS (SELECT case_id, n, 0 AS pairs, 0::BIGINT AS total, []::BIGINT[] AS ds, 0 AS pairs2, 0::BIGINT AS total2, []::BIGINT[] AS ds2 FROM line WHERE n = 1
      UNION ALL SELECT case_id, n, CASE WHEN take THEN pairs2 + 1 ELSE pairs END, CASE WHEN take THEN total2 - d ELSE total END, CASE WHEN take THEN list_append(ds2, d) ELSE ds END, pairs, total, ds
      FROM (SELECT l.case_id, l.n, l.d, b.* EXCLUDE (case_id, n), l.close AND (pairs2 + 1 > pairs OR pairs2 + 1 = pairs AND total2 - l.d >= total) AS take FROM best b JOIN line l ON l.case_id = b.case_id AND l.n = b.n + 1)),
    counted AS (SELECT case_id, max(n) AS n, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM line GROUP BY case_id)"""

ORACLES = {
    "hash_bits": f"WITH {_PHASH} SELECT frame, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY k) AS bits FROM bits GROUP BY frame",
    "hash_scenes": f"WITH RECURSIVE {_HASH_CUTS}, {_greedy('cuts', 'hc', 3)}, {_spans('cuts')} SELECT * FROM spans",
    "frame_fingerprints": f"WITH {_PRINT} SELECT frame, string_agg(CASE WHEN x > m THEN '1' ELSE '0' END, '' ORDER BY k) AS print FROM low JOIN middle USING (frame) GROUP BY frame",
    "edge_distance": f"WITH RECURSIVE {_EDGES} SELECT o.frame, CASE WHEN o.prev IS NULL THEN 0 ELSE 255.0::DOUBLE * count(d.k) / 64 END AS delta_edges FROM ord o LEFT JOIN differ d ON d.frame = o.frame GROUP BY o.frame, o.prev",
    "compare_runs": f"WITH RECURSIVE {_RATIO}, {_adaptive('ga', 3)}, {_adaptive('gb', 4)} SELECT coalesce(ga.video_id, gb.video_id) AS video_id, CASE WHEN gb.frame IS NULL THEN 'current_only' WHEN ga.frame IS NULL THEN 'saved_only' ELSE 'shared' END AS kind, ga.frame / 10.0::DOUBLE AS current, gb.frame / 10.0::DOUBLE AS saved FROM ga FULL JOIN gb ON ga.video_id = gb.video_id AND ga.frame BETWEEN gb.frame - 2 AND gb.frame + 2",
    "boundary_match_tolerant": f"WITH RECURSIVE {_TOLERANT} SELECT case_id, r AS reference_boundaries, c AS candidate_boundaries, pairs::BIGINT AS matched_boundaries, c - pairs AS false_positives, r - pairs AS false_negatives, coalesce(list_max(ds), 0) AS max_absolute_delta, coalesce(list_avg(ds), 0) AS mean_absolute_delta FROM best JOIN counted USING (case_id, n)",
    "content_scenes": f"WITH {_CONTENT}, {_CUTS}, {_spans('cuts')} SELECT * FROM spans",
    "hsv_pixels": f"WITH {_RGB}, {_hsv('rgb')} SELECT frame, k::INT AS pixel, h::INT AS h, s::INT AS s, v::INT AS v FROM hsv",
    "luma_mean": f"WITH {_RGB} SELECT frame, round(avg({_LUMA}), 6) AS average_rgb FROM rgb GROUP BY frame",
    "luma_histogram": f"WITH {_HIST} SELECT frame, bin, round(x, 6) AS x FROM hist",
    "compact_luma": f"WITH {_RGB}, cell AS (SELECT unnest(generate_series(0, 15)) AS cell) SELECT frame, cell::INT AS cell, ((77 * r + 150 * g + 29 * b + 128) >> 8)::INT AS luma FROM cell JOIN rgb ON k = least((2 * (cell // 4) + 1) * 3 // 8, 2) * 7 + least((2 * (cell % 4) + 1) * 7 // 8, 6)",
    "content_scores": f"WITH {_COLOR} SELECT frame, round((dh + ds + dv) / (n * 3), 6) AS content_val FROM delta",
    "wide_content_scores": f"WITH {_WIDE_CONTENT} SELECT frame, round((h + s + v) / 3, 6) AS content_val, round(h, 6) AS delta_hue, round(s, 6) AS delta_saturation, round(v, 6) AS delta_luminance FROM delta",
    "wide_features": f"WITH {_WIDE_FEATURES} SELECT frame, round(m * 57600000)::BIGINT AS luma_total, round(bin_7, 6) AS bin_7, round(hist_sum, 6) AS hist_sum, bits FROM mean JOIN hist USING (frame) JOIN bits USING (frame)",
    "binary_content_scores": f"WITH {_COLOR} SELECT frame, round((dh + ds + dv) / (n * 3), 6) AS content_val FROM delta",
    "content_components": f"WITH {_COLOR} SELECT frame, round((0.5::DOUBLE * dh + ds + 2 * dv) / (n * 3.5::DOUBLE), 6) AS content_val, round(dh / n, 6) AS delta_hue, round(ds / n, 6) AS delta_saturation, round(dv / n, 6) AS delta_luminance, 0.0::DOUBLE AS delta_edges FROM delta",
    "content_luma_only": f"WITH {_COLOR} SELECT frame, round(dv / n, 6) AS content_val FROM delta",
    "content_decisions": f"WITH {_CONTENT}, {_CUTS} SELECT s.frame, round(score, 6) AS score, 10.0::DOUBLE AS threshold, CASE WHEN s.frame = (SELECT min(frame) FROM score) THEN 'not_evaluated' WHEN o.ok THEN 'accepted' WHEN NOT o.ok THEN 'suppressed_min_scene_len' ELSE 'below_threshold' END AS decision FROM score s LEFT JOIN over_ o ON o.frame = s.frame",
    "content_merge_last": f"""WITH {_CONTENT}, {_CUTS}, {_spans('cuts')}, n AS (SELECT max(scene_number) AS n FROM spans), short AS (SELECT n > 1 AND (SELECT "end" - start FROM spans WHERE scene_number = n) < 400 AS yes FROM n)
      SELECT video_id, scene_number, start, CASE WHEN yes AND scene_number = n - 1 THEN (SELECT total FROM total) ELSE "end" END AS "end" FROM spans, n, short WHERE NOT (yes AND scene_number = n)""",
    "hist_scores": f"WITH {_CORR} SELECT frame, round(x, 6) AS hist_diff, first FROM corr_",
    "hist_scenes": f"WITH RECURSIVE {_CORR}, hc AS (SELECT 0 AS video_id, frame FROM corr_ WHERE NOT first AND x <= 1 - 0.15::DOUBLE), {_greedy('cuts', 'hc', 3)}, total AS (SELECT count(*) AS total FROM ord), {_spans('cuts')} SELECT * FROM spans",
    "adaptive_scores": f"WITH {_RATIO} SELECT video_id, frame, round(r, 6) AS adaptive_ratio FROM ratio",
    "adaptive_scenes": f"WITH RECURSIVE {_ADAPTIVE_SPANS} SELECT * FROM spans",
    "fade_events": f"WITH {_FADES} SELECT * FROM fades",
    "fade_scenes": f"WITH RECURSIVE {_FADE_SPANS} SELECT * FROM spans",
    "stats_long_to_wide": f"WITH {_STREAM} SELECT video_id, frame, x AS content_val, x / 2 AS half, 0.0::DOUBLE AS missing FROM stream",
    "stats_rows_decisions": f"WITH RECURSIVE {_ADAPTIVE_SPANS} SELECT r.video_id, r.frame, CASE WHEN r.frame = 0 THEN 'not_evaluated' WHEN s.start IS NOT NULL THEN 'accepted' WHEN r.r >= 3 AND r.x >= 15 THEN 'suppressed_min_scene_len' ELSE 'below_threshold' END AS decision FROM ratio r LEFT JOIN spans s ON s.video_id = r.video_id AND s.start = r.frame",
    "stored_scenes": f"WITH RECURSIVE {_ADAPTIVE_SPANS} SELECT * FROM spans",
    "threshold_preview": f"WITH {_STREAM} SELECT video_id, frame, x AS score FROM stream WHERE frame > 0 AND frame % 2 = 0 AND x >= 60",
    "scene_counts": f"WITH RECURSIVE {_FADE_SPANS} SELECT video_id, greatest(count(*) - 1, 0) AS boundaries FROM spans GROUP BY video_id",
    "boundary_review": f"WITH {_REVIEW} SELECT frame, status, row_number() OVER (ORDER BY frame)::INT AS candidate_number, row_number() OVER (ORDER BY abs(score - 10), frame)::INT AS rank, round(abs(score - 10), 6) AS threshold_distance FROM seeds",
    "review_context": f"""WITH {_REVIEW} SELECT c.frame, CASE WHEN c.frame = s.start AND c.frame > 0 THEN p.start ELSE s.start END AS before_start, CASE WHEN c.frame = s.start AND c.frame > 0 THEN p."end" ELSE c.frame END AS before_end,
      c.frame AS after_start, s."end" AS after_end FROM seeds c JOIN spans s ON c.frame >= s.start AND c.frame < s."end" LEFT JOIN spans p ON p.scene_number = s.scene_number - 1""",
    "adaptive_review": f"WITH RECURSIVE {_RATIO}, {_adaptive('ga', 3)} SELECT r.video_id, r.frame, CASE WHEN ga.frame IS NOT NULL THEN 'accepted' WHEN r.r >= 3 THEN 'suppressed_min_scene_len' ELSE 'near_miss' END AS status, row_number() OVER (PARTITION BY r.video_id ORDER BY r.frame)::INT AS candidate_number, round(r.r, 6) AS score FROM ratio r LEFT JOIN ga ON ga.video_id = r.video_id AND ga.frame = r.frame WHERE r.x >= 15 AND r.r >= 3 * 0.8::DOUBLE",
    "effective_boundaries": f"WITH RECURSIVE {_EFFECTIVE} SELECT * FROM eff",
    "reviewed_scenes": f"WITH RECURSIVE {_EFFECTIVE}, {_video_spans('eff', 'reviewed')} SELECT * FROM reviewed",
    "threshold_diff": f"WITH RECURSIVE {_RATIO}, {_adaptive('ga', 3)}, {_adaptive('gb', 4)} SELECT *, 'added' AS change FROM (SELECT video_id, frame FROM gb EXCEPT SELECT video_id, frame FROM ga) UNION ALL SELECT *, 'removed' FROM (SELECT video_id, frame FROM ga EXCEPT SELECT video_id, frame FROM gb)",
    "scene_timeline": f"WITH RECURSIVE {_FADE_SPANS}, t AS (SELECT video_id, frame, epoch_us(ts) AS ticks FROM stream) SELECT s.video_id, scene_number, a.ticks AS start_ticks, b.ticks AS end_ticks FROM spans s JOIN t a ON a.video_id = s.video_id AND a.frame = s.start LEFT JOIN t b ON b.video_id = s.video_id AND b.frame = s.\"end\"",
    "stride_samples": f"WITH {_SIGN} SELECT frame, hash FROM sign WHERE frame % 3 = 0",
    "scene_selection": f"WITH {_SIGN}, {_BLOCKS}, n AS (SELECT count(*) AS n FROM spans) SELECT scene_number, start, \"end\" FROM spans, n WHERE n <= 64 OR scene_number - 1 IN (SELECT k * (n.n - 1) // 63 FROM n, (SELECT unnest(generate_series(0, 63)) AS k))",
    "scene_majority_hash": f"WITH {_MAJORITY} SELECT * FROM major",
    "scene_similarity_pairs": f"""WITH {_MAJORITY}, n AS (SELECT count(*) AS n FROM spans), chosen AS (SELECT major.* FROM major, n WHERE n <= 1024 OR scene_number - 1 IN (SELECT k * (n.n - 1) // 1023 FROM n, (SELECT unnest(generate_series(0, 1023)) AS k))),
      pair AS (SELECT a.scene_number AS first_scene, b.scene_number AS second_scene, bit_count(xor(a.hash, b.hash))::INT AS distance FROM chosen a JOIN chosen b ON a.scene_number < b.scene_number)
      SELECT row_number() OVER (ORDER BY distance, first_scene, second_scene)::INT AS rank, *, 1 - distance / 64.0::DOUBLE AS similarity FROM pair QUALIFY rank <= 48""",
    "similarity_report": f"""WITH {_SIGN}, {_BLOCKS}, n AS (SELECT count(*) AS n FROM spans), chosen AS (SELECT spans.* FROM spans, n WHERE n <= 64 OR scene_number - 1 IN (SELECT k * (n.n - 1) // 63 FROM n, (SELECT unnest(generate_series(0, 63)) AS k))),
      known AS (SELECT count(DISTINCT scene_number) AS k FROM chosen JOIN sign ON frame >= start AND frame < "end" AND frame % 7 = 0)
      SELECT n AS total_scenes, (SELECT count(*) FROM chosen) AS selected_scenes, k AS considered_scenes, (SELECT count(*) FROM chosen) - k AS without_fingerprint, n > (SELECT count(*) FROM chosen) AS truncated FROM n, known""",
    "nearest_sample": f"""WITH {_MEDIA}, point AS (SELECT video_id, k, floor(e * k / 20) AS time FROM (SELECT video_id, max(t) AS e FROM media GROUP BY video_id), (SELECT unnest(generate_series(0, 20)) AS k))
      SELECT video_id, k::INT AS k, time, sample FROM (SELECT p.*, m.sample, row_number() OVER (PARTITION BY p.video_id, p.k ORDER BY CASE WHEN m.t <= p.time THEN p.time - m.t ELSE m.t - p.time END, m.sample) AS o FROM point p JOIN media m USING (video_id)) WHERE o = 1""",
    "previous_sample": f"WITH {_MEDIA}, s AS (SELECT video_id, sample FROM media), p AS (SELECT video_id, sample - 1 AS sample_at FROM s UNION ALL SELECT video_id, sample + 1 FROM s) SELECT video_id, sample_at, coalesce((SELECT max(sample) FROM s WHERE s.video_id = p.video_id AND s.sample < p.sample_at), greatest(0, sample_at - 1)) AS previous FROM p",
    "score_downsample": f"WITH {_STREAM} SELECT video_id, floor(coalesce(frame::DOUBLE / nullif(total - 1, 0), 0) * 15)::BIGINT AS bucket, max(x) AS content_val FROM stream JOIN totals USING (video_id) GROUP BY 1, 2",
    "boundary_match_pairs": f"WITH RECURSIVE {_PAIRS} SELECT video_id::VARCHAR AS case_id, kind, rf AS reference_frame, cf AS candidate_frame, cf - rf AS delta FROM walk WHERE kind IS NOT NULL",
    "boundary_match": f"WITH RECURSIVE {_MATCH} SELECT * FROM found",
    "boundary_match_totals": f"WITH RECURSIVE {_MATCH} SELECT count(DISTINCT case_id) AS cases, count(*) FILTER (kind <> 'false_positive') AS reference_boundaries, count(*) FILTER (kind <> 'false_negative') AS candidate_boundaries, count(*) FILTER (kind = 'match') AS matched_boundaries, count(*) FILTER (kind = 'false_positive') AS false_positives, count(*) FILTER (kind = 'false_negative') AS false_negatives FROM found",
    "worst_divergences": f"WITH RECURSIVE {_MATCH} SELECT case_id, kind, frame, 0::BIGINT AS absolute_delta, 2 AS severity FROM found WHERE kind <> 'match' ORDER BY case_id, kind, frame LIMIT 25",
    "parity_compare": f"""WITH RECURSIVE {_EFFECTIVE}, {_video_spans('eff', 'reviewed')}
      SELECT coalesce(e.video_id, a.video_id) AS video_id, coalesce(e.scene_number, a.scene_number) AS scene, abs(e.start - a.start) AS start_delta, abs(e."end" - a."end") AS end_delta FROM spans e FULL JOIN reviewed a ON e.video_id = a.video_id AND e.scene_number = a.scene_number WHERE e.start IS NULL OR a.start IS NULL OR abs(e.start - a.start) > 1 OR abs(e."end" - a."end") > 1""",
    "bench_pairs": """WITH m AS (SELECT o_orderpriority AS id, o_orderstatus = 'F' AS first, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1, 2), p AS (SELECT id, max(mean) FILTER (first) AS reference, max(mean) FILTER (NOT first) AS candidate FROM m GROUP BY id)
      SELECT *, round(reference / candidate, 6) AS ratio, CASE WHEN candidate < reference THEN 'candidate' WHEN candidate > reference THEN 'reference' ELSE 'tie' END AS winner FROM p""",
    "timecodes": """WITH t AS (SELECT event_id * 37 AS frame, round_even((event_id * 37)::DOUBLE * 1000 / 23.976::DOUBLE, 0)::BIGINT AS ms, (event_id * 37)::DOUBLE / 23.976::DOUBLE AS s FROM events)
      SELECT frame, ms // 3600000 AS hours, ms // 60000 % 60 AS minutes, ms // 1000 % 60 AS seconds, ms % 1000 AS millis, floor((s % 3600) / 60)::BIGINT AS core_minutes, frame * 30 AS parsed FROM t""",
    "sample_times": """WITH v AS (SELECT c_custkey AS video_id, c_custkey % 7 + 0.5::DOUBLE AS duration FROM customer) SELECT video_id, sample, round(least(sample / 4.0::DOUBLE, duration - 0.001::DOUBLE), 6) AS target FROM (SELECT *, unnest(generate_series(0, greatest(1, ceil(duration * 4))::BIGINT - 1)) AS sample FROM v)""",
}
