"""The SQL that each query is held against, in the dialect of DuckDB."""

from __future__ import annotations

from sightline.functions.plates import BH, STATE
from sightline.plans import views
from sightline.plans.queries import THRESHOLDS
from sightline.plans.views import plain

OBS, MAP = plain(views.OBSERVATIONS), plain(views.MAPPING)
CLEAN = "regexp_replace(upper(raw_text), '[^A-Z0-9]', '', 'g')"
_BASE = f"obs AS (SELECT *, {CLEAN} AS text FROM ({OBS}))"
_L = lambda x: f"translate({x}, '012568', 'OIZSGB')"
_D = lambda x: f"translate({x}, 'OQDILZSGB', '000112568')"
_O = lambda x: f"translate({x}, 'OILZSBG', '0112586')"
_N = lambda x, k: f"length(regexp_replace({x}, '[^{k}]', '', 'g'))"


def _windows(masks: list[tuple[int, int]], score: str, name: str, table=_D) -> str:
    """CTEs w, c and the one called name: the best window of each observation under masks (series, number)."""
    values = ", ".join(f"({i}, {s}, {n}, {4 + s + n})" for i, (s, n) in enumerate(masks))
    return f"""
    {name}_w AS (SELECT ord, text, o, s, n, size, unnest(range(1, length(text) - size + 2)) AS st FROM obs, (VALUES {values}) v(o, s, n, size) WHERE length(text) >= size),
    {name}_p AS (SELECT *, length(text) - size AS removed, substr(text, st, 2) AS a, substr(text, st + 2, 2) AS b, substr(text, st + 4, s) AS c, substr(text, st + 4 + s, n) AS e FROM {name}_w),
    {name}_q AS (SELECT *, {_L('a')} || {table('b')} || {_L('c')} || {table('e')} AS plate, {_N('a || c', '0-9')} + {_N('b || e', 'A-Z')} AS cost FROM {name}_p),
    {name} AS (SELECT * FROM (SELECT ord, plate, cost, removed, st, row_number() OVER (PARTITION BY ord ORDER BY {score}, o, st) AS rn FROM {name}_q
        WHERE regexp_full_match(plate, '{STATE}[0-9]{{2}}[A-Z]+[0-9]+') AND regexp_full_match(substr(plate, 5, s), '[A-Z]+') AND regexp_full_match(substr(plate, 5 + s), '[0-9]+')) WHERE rn = 1)"""


_MASKS = [(s, n) for s in (1, 2, 3) for n in (1, 2, 3, 4)]
PARSED = _windows([(1, 4), (2, 4)], "100 * cost + 25 * removed - 2 * size, cost, removed", "best")
FUSED = _windows(_MASKS, "100 * cost + 35 * removed - size", "fused")
STANDARD = _windows(_MASKS, "cost", "std", _O).replace("WHERE length(text) >= size)", "WHERE length(text) = size)")
_CORRECT = f"""{STANDARD},
    bhp AS (SELECT ord, {_O("substr(text, 1, 2)")} || {_L("substr(text, 3, 2)")} || {_O("substr(text, 5, 4)")} || {_L("substr(text, 9, 2)")} AS plate,
        {_N("substr(text, 1, 2) || substr(text, 5, 4)", "A-Z")} + {_N("substr(text, 3, 2) || substr(text, 9, 2)", "0-9")} AS cost FROM obs WHERE length(text) = 10),
    fix AS (SELECT ord, CASE WHEN s.plate IS NOT NULL AND (b.plate IS NULL OR s.cost <= b.cost) THEN s.plate ELSE b.plate END AS plate,
        CASE WHEN s.plate IS NOT NULL AND (b.plate IS NULL OR s.cost <= b.cost) THEN s.cost ELSE b.cost END AS cost
        FROM obs LEFT JOIN std s USING (ord) LEFT JOIN (SELECT * FROM bhp WHERE regexp_full_match(plate, '{BH}')) b USING (ord)),
    corrected AS (SELECT ord, CASE WHEN cost <= 2 THEN plate END AS plate, CASE WHEN cost <= 2 THEN cost END AS cost FROM fix)"""
_CLUSTERED = f"""{_BASE}, {PARSED}, map AS ({MAP}),
    o AS (SELECT obs.*, coalesce(best.plate, '') AS plate, coalesce(best.cost, -1) AS correction, coalesce(map.cluster_id, obs.track_id) AS cluster_id
          FROM obs LEFT JOIN best USING (ord) LEFT JOIN map ON obs.track_id = map.track_id),
    v AS (SELECT cluster_id, plate, count(DISTINCT frame) AS frame_support, count(DISTINCT track_id) AS track_support, avg(confidence) AS mean_confidence,
          avg(correction) AS mean_correction, avg(quality) AS mean_quality, min(ord) AS first_seen FROM o WHERE plate <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY frame_support DESC, round(mean_confidence, 9) DESC, round(mean_correction, 9), round(mean_quality, 9) DESC, first_seen) AS candidate_rank FROM v)"""
_LCS = """list_max(list_filter(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({a}) - i + 2), lambda n: {{'n': n, 'i': -i, 's': substr({a}, i, n)}}))), lambda x: contains({b}, x.s)))"""
_FRAG = f"""{_CLUSTERED},
    sel AS (SELECT cluster_id, plate AS candidate FROM r WHERE candidate_rank = 1),
    ful AS (SELECT DISTINCT o.cluster_id, o.frame FROM o JOIN sel ON o.cluster_id = sel.cluster_id AND o.plate = sel.candidate),
    rest AS (SELECT o.*, sel.candidate FROM o JOIN sel USING (cluster_id) WHERE NOT EXISTS (SELECT 1 FROM ful WHERE ful.cluster_id = o.cluster_id AND ful.frame = o.frame)),
    l AS (SELECT *, coalesce({_LCS.format(a='candidate', b='text')}.s, '') AS fragment FROM rest),
    f AS (SELECT * FROM (SELECT cluster_id, candidate, frame, fragment, track_id, length(fragment) AS fragment_length, min(ord) OVER (PARTITION BY cluster_id, frame) AS inserted, row_number() OVER (PARTITION BY cluster_id, frame ORDER BY length(fragment) DESC, ord) AS rn
          FROM l WHERE length(fragment) >= greatest(6, ceil(0.6 * length(candidate))) AND regexp_matches(fragment, '[A-Z]') AND regexp_matches(fragment, '[0-9]')) WHERE rn = 1)"""
_CONS = f"""{_FRAG},
    bf AS (SELECT cluster_id, arg_max(fragment, {{'a': fragment_length, 'b': -inserted}}) AS best_fragment, max(fragment_length) AS best_fragment_length, count(*) AS fragment_support, count(DISTINCT track_id) AS fragment_tracks FROM f GROUP BY 1),
    cons AS (SELECT c.cluster_id, member_tracks, coalesce(plate, '') AS final_plate, coalesce(frame_support, 0) AS frame_support, coalesce(track_support, 0) AS track_support, coalesce(fragment_support, 0) AS fragment_support,
        coalesce(fragment_tracks, 0) AS fragment_tracks, coalesce(best_fragment_length, 0) AS best_fragment_length, round(mean_confidence, 6) AS mean_confidence, round(mean_correction, 4) AS mean_correction, round(mean_quality, 4) AS mean_quality,
        coalesce(best_fragment, '') AS best_fragment, CASE WHEN frame_support IS NULL THEN 'REJECTED' WHEN frame_support >= 2 THEN 'VERIFIED_FULL' WHEN fragment_support >= 1 THEN 'CORROBORATED_FRAGMENT' ELSE 'NEEDS_REVIEW' END AS evidence_status
        FROM (SELECT cluster_id, array_to_string(list_sort(list(DISTINCT track_id)), '|') AS member_tracks FROM o GROUP BY 1) c LEFT JOIN (SELECT * FROM r WHERE candidate_rank = 1) x USING (cluster_id) LEFT JOIN bf USING (cluster_id))"""
_PRF = "CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS r"
_METRICS = "round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS f1"
_REVIEW = f"(SELECT *, correct <= detections AND correct <= visible AND correct >= 0 AS valid, correct AS tp, detections - correct AS fp, visible - correct AS fn FROM ({plain(views.COUNTS)}))"
_SWEEP = f"""WITH s AS (SELECT (id % 97) / 97.0::DOUBLE AS score, visible > 0 AS truth FROM ({plain(views.COUNTS)})),
    c AS (SELECT t AS threshold, count(*) FILTER (score >= t AND truth) AS tp, count(*) FILTER (score >= t AND NOT truth) AS fp, count(*) FILTER (score < t AND truth) AS fn
          FROM s, (VALUES {', '.join(f'({x}::DOUBLE)' for x in THRESHOLDS)}) v(t) GROUP BY 1),
    m AS (SELECT *, {_PRF} FROM c), points AS (SELECT threshold, tp, fp, fn, {_METRICS} FROM m)"""
_CLASS = lambda order: "CASE WHEN pred = '' THEN 'NO_TEXT' WHEN pred = truth THEN 'EXACT' WHEN contains(pred, truth) THEN 'GT_WITH_EXTRA_TEXT' " + " ".join(order) + " WHEN levenshtein(pred, truth) <= 2 THEN 'NEAR_MATCH' ELSE 'MAJOR_ERROR' END"
_ORDER = ["WHEN list_sort(string_split(pred, '')) = list_sort(string_split(truth, '')) THEN 'CHAR_ORDER_ERROR'", "WHEN length(pred) = length(truth) THEN 'SAME_LENGTH_CHAR_ERRORS'"]
_IMG = f"({plain(views.IMAGES)})"
_MIX = f"(SELECT image_id, 'base' AS domain, 1 AS repeat FROM {_IMG} WHERE split = 'train' UNION ALL SELECT image_id, 'road', unnest(range(1, 21)) FROM {_IMG} WHERE split = 'val')"
_CLUSTERS = f"""WITH RECURSIVE crops AS ({plain(views.CROPS)}), low AS (SELECT digest, frame, min(track_id) AS a FROM crops GROUP BY ALL),
    e0 AS (SELECT DISTINCT a, track_id AS b FROM crops JOIN low USING (digest, frame) WHERE a <> track_id), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
    reach AS (SELECT DISTINCT track_id, track_id AS other FROM crops UNION SELECT reach.track_id, e.b FROM reach JOIN e ON reach.other = e.a),
    lab AS (SELECT track_id, min(other) AS cluster_id FROM reach GROUP BY 1)"""
_VALID = f"regexp_full_match(text, '[A-Z]{{2}}[0-9]{{1,2}}[A-Z]{{1,3}}[0-9]{{1,4}}|{BH}')"
_COUNTED = f"(length(text) BETWEEN 6 AND 12 AND {_N('text', 'A-Z')} >= 2 AND {_N('text', '0-9')} >= 2)"
_STATED = f"(length(text) BETWEEN 7 AND 11 AND regexp_matches(text, '^{STATE}[0-9OILZSBG]{{2}}') AND regexp_matches(substr(text, 5), '[A-Z]') AND regexp_matches(substr(text, 5), '[0-9]'))"
_FUSEDW = "0.55 * confidence + 0.25 * quality + 0.2 * detection - 0.05 * greatest(cost, 0)"
_VOTEW = "0.5 * confidence + 0.3 * quality + 0.2 * detection"
_FUSEDP = f"""fp AS (SELECT obs.*, CASE WHEN fused.plate IS NULL AND regexp_full_match(text, '{BH}') THEN text ELSE coalesce(fused.plate, '') END AS plate0, fused.plate AS fplate, fused.cost AS fcost,
        100 * fused.cost + 35 * fused.removed - length(fused.plate) AS fscore FROM obs LEFT JOIN fused USING (ord)),
    parsed AS (SELECT * EXCLUDE (plate0), CASE WHEN regexp_full_match(text, '{BH}') AND (fscore IS NULL OR fscore > -10) THEN text ELSE coalesce(fplate, '') END AS plate,
        CASE WHEN regexp_full_match(text, '{BH}') AND (fscore IS NULL OR fscore > -10) THEN 0 ELSE coalesce(fcost, -1) END AS cost FROM fp)"""

ORACLES: dict[str, str] = {
    "consensus": f"WITH {_CONS} SELECT * FROM cons",
    "clean_text": f"WITH {_BASE} SELECT ord, text AS clean, regexp_matches(text, '[A-Z]') AND regexp_matches(text, '[0-9]') AS mixed FROM obs",
    "parse_plate": f"WITH {_BASE}, {PARSED} SELECT ord, coalesce(plate, '') AS plate, coalesce(cost, -1) AS cost, coalesce(removed, 999) AS removed, coalesce(st - 1, -1) AS start FROM obs LEFT JOIN best USING (ord)",
    "parse_fused": f"WITH {_BASE}, {FUSED}, {_FUSEDP} SELECT ord, plate, cost FROM parsed",
    "correct_plate": f"WITH {_BASE}, {_CORRECT} SELECT ord, plate, cost FROM corrected",
    "plate_validity": f"""WITH {_BASE} SELECT ord, {_COUNTED} AS by_counts, {_STATED} AS by_state, {_VALID} AS format_ok,
        regexp_full_match(text, '{STATE}[0-9]{{2}}[A-Z]{{1,3}}[0-9]{{1,4}}|{BH}') AS state_ok,
        CASE WHEN {_VALID} AND confidence >= 0.6 THEN 'FORMAT_VALID' WHEN {_VALID} OR {_COUNTED} THEN 'NEEDS_REVIEW' ELSE 'REJECTED' END AS class FROM obs""",
    "attempt_scores": f"""WITH {_BASE}, {_CORRECT} SELECT ord, round(confidence + CASE WHEN plate IS NOT NULL THEN 0.4 - 0.08 * cost WHEN {_STATED} THEN 0.1 ELSE 0.0 END, 6) AS s1,
        round(confidence + CASE WHEN {_VALID} THEN 0.4 WHEN {_COUNTED} THEN 0.1 ELSE 0.0 END, 6) AS s2, round({_FUSEDW.replace('cost', 'coalesce(cost, -1)')}, 6) AS fusion, round({_VOTEW}, 6) AS vote FROM obs JOIN corrected USING (ord)""",
    "common_substrings": f"WITH {_BASE} SELECT ord, coalesce({_LCS.format(a='truth', b='text')}.s, '') AS lcs, CAST(greatest(6, ceil(0.6 * length(truth))) AS INT) AS least FROM obs",
    "reading_errors": f"""WITH o AS ({plain(views.READINGS)}), e AS (SELECT *, levenshtein(pred, truth) AS d1, levenshtein(other, truth) AS d2 FROM o)
        SELECT id, d1, d2, {_CLASS(_ORDER)} AS first_class, {_CLASS(_ORDER[::-1])} AS second_class, CASE WHEN d1 < d2 THEN 'first' WHEN d2 < d1 THEN 'second' ELSE 'Tie' END AS winner,
        CASE WHEN pred = truth THEN 'EXACT' WHEN d1 < d2 THEN 'IMPROVED' WHEN d1 > d2 THEN 'WORSE' ELSE 'UNCHANGED' END AS change, pred <> '' AND contains(pred, truth) AS contains, coalesce(nullif(pred, ''), other) AS filled FROM e""",
    "reading_metrics": f"""SELECT count(*) AS n, sum((pred = truth)::INT) AS exact, round(avg((pred = truth)::INT), 9) AS accuracy, sum(levenshtein(pred, truth)) AS edits,
        round(sum(levenshtein(pred, truth)) / sum(length(truth)), 9) AS cer, round(avg((pred = '')::INT), 9) AS blank_rate FROM ({plain(views.READINGS)})""",
    "augmented_sources": "SELECT page_id, 'V_P_I_' || page_id % 50 AS source, 'V_P_I_' || page_id % 50 AS frame FROM pages",
    "box_geometry": f"""WITH b AS ({plain(views.BOXES)}), c AS (SELECT *, greatest(x, 0) AS l, greatest(y, 0) AS t FROM b), e AS (SELECT *, least(w, w_img - l) AS cw, least(h, h_img - t) AS ch FROM c WHERE w > 0 AND h > 0),
        g AS (SELECT *, (l + cw / 2) / w_img AS xc, (t + ch / 2) / h_img AS yc, cw / w_img AS bw, ch / h_img AS bh FROM e WHERE cw > 0 AND ch > 0)
        SELECT id, round(xc, 9) AS xc, round(yc, 9) AS yc, round(bw, 9) AS bw, round(bh, 9) AS bh, round((xc - bw / 2) * w_img, 9) AS x1, round((yc + bh / 2) * h_img, 9) AS y2,
        round(cw * ch / (w_img * h_img), 9) AS share, w >= 10 AND h >= 5 AND w / greatest(h, 1) BETWEEN 1.2 AND 6.5 AS big FROM g""",
    "quality_scores": f"""SELECT id, round(0.55 * (w / 40) + 0.25 * least(w * h * 20 / 15000, 1) + 0.1 * least(x * 6 / 500, 1) + 0.1 * least(h / 70, 1), 9) AS q1,
        round(0.5 * (0.6 * least(1, w * 6 / 180) + 0.4 * least(1, h * 3 / 60)) + 0.35 * least(1, y * 10 / 800) + 0.15 * least(1, x / 60), 9) AS q2 FROM ({plain(views.BOXES)})""",
    "crop_names": f"""SELECT seq, printf('track_%04d_rank_%d_frame_%05d_score_%.3f.jpg', track_id, seq % 5, frame, floor(score) + 0.5) AS name, track_id::INT AS track, frame::INT AS frame, floor(score) + 0.5 AS score FROM ({plain(views.CANDIDATES)})""",
    "label_hard_examples": f"""SELECT id, valid, tp, fp, fn, concat_ws(';', CASE WHEN fp > 0 AND visible = 0 THEN 'pure_hard_negative' END, CASE WHEN fp > 0 AND visible > 0 THEN 'mixed_false_positive' END,
        CASE WHEN fn > 0 THEN 'false_negative_positive_candidate' END) AS labels FROM {_REVIEW}""",
    "inconsistent_counts": f"SELECT id, tp, fp, fn + 1 AS fn FROM {_REVIEW} WHERE id % 9 = 0",
    "detection_metrics": f"WITH g AS (SELECT video, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM {_REVIEW} GROUP BY ROLLUP (video)), m AS (SELECT *, {_PRF} FROM g) SELECT video, tp, fp, fn, {_METRICS} FROM m",
    "evidence_bounds": f"""WITH g AS (SELECT sum(CASE WHEN visible = 0 THEN detections ELSE 0 END) AS guaranteed_fp, sum(CASE WHEN detections = 0 THEN visible ELSE 0 END) AS guaranteed_fn, sum(least(visible, detections)) AS max_tp,
        sum(detections) AS n_det, sum(visible) AS n_vis FROM ({plain(views.COUNTS)})), h AS (SELECT *, n_det - max_tp AS min_fp, n_vis - max_tp AS min_fn, max_tp AS tp, n_det - max_tp AS fp, n_vis - max_tp AS fn FROM g),
        m AS (SELECT *, {_PRF} FROM h), k AS (SELECT *, {_METRICS} FROM m) SELECT guaranteed_fp, guaranteed_fn, max_tp, n_det, n_vis, min_fp, min_fn, precision AS best_precision, recall AS best_recall, f1 AS best_f1,
        precision < 0.99 AND recall < 0.9 AND f1 < 0.95 AS reject FROM k""",
    "threshold_sweep": f"{_SWEEP} SELECT * FROM points",
    "operating_point": f"{_SWEEP} SELECT threshold, precision, recall, f1 FROM points ORDER BY recall >= 0.75 DESC, f1 DESC, precision DESC, threshold LIMIT 1",
    "cluster_votes": f"WITH {_CLUSTERED} SELECT cluster_id, plate, frame_support, track_support, round(mean_confidence, 6) AS mean_confidence, round(mean_correction, 6) AS mean_correction, round(mean_quality, 6) AS mean_quality FROM v",
    "candidate_ranks": f"WITH {_CLUSTERED} SELECT cluster_id, plate, frame_support, candidate_rank, candidate_rank = 1 AS selected FROM r",
    "fragment_evidence": f"WITH {_FRAG} SELECT cluster_id, candidate, frame, fragment, fragment_length FROM f",
    "status_histogram": f"WITH {_CONS} SELECT evidence_status, count(*) AS n, count(DISTINCT final_plate) AS plates FROM cons GROUP BY 1",
    "fused_tracks": f"""WITH {_BASE}, {FUSED}, {_FUSEDP}, g AS (SELECT track_id, plate, count(DISTINCT frame) AS frame_support, count(*) AS variant_support, avg(confidence) AS mc, avg(cost) AS mcost, sum({_FUSEDW}) AS total, min(ord) AS first_seen
        FROM parsed WHERE plate <> '' GROUP BY ALL), h AS (SELECT *, round(2.0 * frame_support + 0.15 * variant_support + total, 6) AS fusion_score FROM g),
        k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_support DESC, fusion_score DESC, first_seen) AS rn FROM h)
        SELECT track_id, plate AS final_plate, CASE WHEN frame_support >= 2 AND mc >= 0.6 THEN 'VERIFIED' WHEN mc >= 0.5 THEN 'NEEDS_REVIEW' ELSE 'REJECTED' END AS status, frame_support, variant_support,
        round(mc, 6) AS mean_confidence, round(mcost, 6) AS mean_cost, fusion_score FROM k WHERE rn = 1""",
    "weighted_consensus": f"""WITH {_BASE}, {_CORRECT}, a AS (SELECT track_id, ord, coalesce(plate, text) AS txt, plate IS NOT NULL AS valid, {_STATED} AS plausible, {_VOTEW} AS weight, confidence + quality AS fallback FROM obs JOIN corrected USING (ord)),
        g AS (SELECT track_id, txt, round(sum(weight), 9) AS w, count(*) AS support, min(ord) AS o FROM a WHERE valid GROUP BY ALL), h AS (SELECT *, sum(support) OVER (PARTITION BY track_id) AS n, row_number() OVER (PARTITION BY track_id ORDER BY w DESC, o) AS rn FROM g),
        sp AS (SELECT track_id, txt AS spare FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(fallback, 9) DESC, ord) AS rn FROM a WHERE plausible AND NOT valid) WHERE rn = 1)
        SELECT t.track_id, coalesce(h.txt, spare, '') AS final_text, CASE WHEN support >= 2 AND support / n >= 0.5 THEN 'VERIFIED' WHEN n IS NOT NULL OR spare IS NOT NULL THEN 'NEEDS_REVIEW' ELSE 'REJECTED' END AS status,
        coalesce(support, CASE WHEN spare IS NOT NULL THEN 1 END, 0) AS support, coalesce(n, 0) AS valid_candidates, round(coalesce(support / n, 0.0), 6) AS consensus_ratio
        FROM (SELECT DISTINCT track_id FROM a) t LEFT JOIN (SELECT * FROM h WHERE rn = 1) h USING (track_id) LEFT JOIN sp USING (track_id)""",
    "truth_of_clusters": f"""WITH {_BASE}, map AS ({MAP}), l AS (SELECT DISTINCT coalesce(map.cluster_id, obs.track_id) AS cluster_id, obs.track_id, CASE WHEN confidence >= 0.95 THEN truth END AS t FROM obs LEFT JOIN map ON obs.track_id = map.track_id)
        SELECT cluster_id, coalesce(string_agg(DISTINCT t, '|' ORDER BY t), '') AS truth, CASE count(DISTINCT t) WHEN 0 THEN 'NO_VERIFIED_GT' WHEN 1 THEN 'CONSISTENT' ELSE 'GT_CONFLICT' END AS truth_status FROM l GROUP BY 1""",
    "shared_crops": f"WITH c AS ({plain(views.CROPS)}) SELECT x.track_id AS a, y.track_id AS b, count(*) AS matches FROM c x JOIN c y ON x.digest = y.digest AND x.frame = y.frame AND x.track_id < y.track_id GROUP BY ALL",
    "track_clusters": f"{_CLUSTERS} SELECT * FROM lab",
    "cluster_members": f"{_CLUSTERS} SELECT cluster_id, count(*) AS member_count, string_agg(track_id::VARCHAR, '|' ORDER BY track_id) AS members, count(*) > 1 AS merged FROM lab GROUP BY 1",
    "best_attempt": f"""WITH {_BASE}, {PARSED}, a AS (SELECT obs.*, coalesce(plate, '') AS plate, coalesce(cost, 99) AS cost, coalesce(removed, 999) AS removed FROM obs LEFT JOIN best USING (ord))
        SELECT track_id, ord, plate, cost FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY cost, removed, confidence DESC, ord) AS rn FROM a) WHERE rn = 1""",
    "best_of_source": f"SELECT source_id, image_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY quality DESC, image_id) AS rn FROM {_IMG}) WHERE rn = 1",
    "top_images": f"SELECT image_id, quality FROM {_IMG} ORDER BY quality DESC, image_id LIMIT 30",
    "split_leaks": f"SELECT source_id, string_agg(DISTINCT split, '|' ORDER BY split) AS splits, count(*) AS n FROM {_IMG} GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "source_split": f"""WITH s AS (SELECT DISTINCT source_id FROM {_IMG}), r AS (SELECT source_id, row_number() OVER (ORDER BY md5(source_id || '|42'), source_id) AS pos, count(*) OVER () AS n FROM s)
        SELECT source_id, CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""",
    "hash_sample": f"SELECT image_id FROM {_IMG} ORDER BY md5(image_id || '|42'), image_id LIMIT 50",
    "mixed_dataset": f"SELECT * FROM {_MIX}",
    "domain_shares": f"SELECT domain, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM {_MIX} GROUP BY 1",
    "region_rows": f"""WITH r AS (SELECT *, round_even(y / 30, 0)::BIGINT AS k FROM ({plain(views.REGIONS)}))
        SELECT image, string_agg(text, '' ORDER BY k, x, text) AS text, round(coalesce(sum(conf * length(text)) / nullif(sum(length(text)), 0), 0), 9) AS confidence FROM r GROUP BY 1""",
    "latency_medians": """SELECT event_type, list_sort(list(value))[(count(*) // 2 + 1)::INT] AS upper, median(value) AS middle, round(avg(CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END), 6) AS extra,
        round(CASE WHEN avg(value) > 0 THEN 1000.0 / avg(value) ELSE 0 END, 6) AS fps FROM events GROUP BY 1""",
    "last_epochs": "SELECT user_id, max(event_id) AS epoch, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "open_items": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 1",
    "upserted": """WITH c AS (SELECT l_orderkey AS id, max(l_returnflag) AS state FROM lineitem GROUP BY 1 HAVING max(l_returnflag) = 'R')
        SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_orderkey NOT IN (SELECT id FROM c) UNION ALL SELECT * FROM c""",
    "seeded": "SELECT doc_id, quality::INT AS quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "annotation_rules": f"SELECT id, id % 4 IN (0, 1) OR (id % 4 = 2 AND length(pred) >= 5) AS sample_ok, id % 4 IN (0, 1) OR (id % 4 = 2 AND length(pred) >= 4) AS track_ok FROM ({plain(views.READINGS)})",
    "box_issues": f"""WITH b AS (SELECT id % 500 AS image, id % 3 % 2 AS class, x / 100 AS xc, y / 80 AS yc, w / 100 AS w, h / 80 AS h FROM ({plain(views.BOXES)})),
        i AS (SELECT image, 2 AS k, 'bad class' AS s FROM b WHERE class <> 0 UNION SELECT image, 3, 'outside' FROM b WHERE least(xc, yc, w, h) < 0 OR greatest(xc, yc, w, h) > 1 UNION SELECT image, 2, 'no area' FROM b WHERE w <= 0 OR h <= 0
              UNION SELECT image, 1, 'count' FROM b GROUP BY 1 HAVING count(*) <> 4)
        SELECT m.image, coalesce(string_agg(s, '; ' ORDER BY (k = 1) DESC, s), '') AS issues FROM (SELECT DISTINCT image FROM b) m LEFT JOIN i USING (image) GROUP BY 1""",
    "sampled_frames": "SELECT DISTINCT round_even(i / 2.0 * 29.97::DOUBLE, 0)::BIGINT AS frame FROM range(0, 41) t(i) WHERE round_even(i / 2.0 * 29.97::DOUBLE, 0) < 500",
    "lenient_casts": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::INT ELSE 0 END AS i, CASE c_custkey % 3 WHEN 0 THEN c_custkey::DOUBLE WHEN 1 THEN 1.5 ELSE 0 END AS f, c_custkey % 2 = 0 AS b FROM customer""",
}

