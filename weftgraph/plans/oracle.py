"""SQL of the same results, written independently of the plans: joins and sets instead of arrays, plain windows."""

from __future__ import annotations

import re

from .queries import BOOT, PERM, REPEATS

_BASE = {
    "edges": "SELECT DISTINCT a.l_partkey AS u, b.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'",
    "members": "SELECT DISTINCT l_partkey AS node, l_suppkey::INT AS comm FROM lineitem WHERE l_quantity >= 45",
    "adj": "SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges",
    "deg": "SELECT u AS node, count(*) AS degree FROM adj GROUP BY u",
    "nodes": "SELECT node FROM deg",
    "nc": "SELECT node, count(*) AS c FROM members GROUP BY node",
    "common": "SELECT a.u, a.v, count(*) AS i FROM adj a JOIN members x ON x.node = a.u JOIN members y ON y.node = a.v AND y.comm = x.comm GROUP BY a.u, a.v",
    "s0": "SELECT node, degree AS s FROM deg",
    "s1": "SELECT n.node, count(DISTINCT z.comm) AS s FROM nodes n LEFT JOIN (SELECT a.u, x.comm FROM adj a JOIN members x ON x.node = a.u JOIN members y ON y.node = a.v AND y.comm = x.comm) z ON z.u = n.node GROUP BY n.node",
    "s2": "SELECT n.node, coalesce(nc.c, 0) AS s FROM nodes n LEFT JOIN nc USING (node)",
    "s3": "SELECT n.node, coalesce(sum(common.i), 0)::BIGINT AS s FROM nodes n LEFT JOIN common ON common.u = n.node GROUP BY n.node",
    "s4": "SELECT * FROM s1",
}
for _s in ("s0", "s1", "s2", "s3"):
    _BASE |= {
        f"t_{_s}": f"SELECT x.node, x.s, count(*) AS d, sum(y.s)::BIGINT AS near FROM {_s} x JOIN adj ON adj.u = x.node JOIN {_s} y ON y.node = adj.v GROUP BY x.node, x.s",
        f"q_{_s}": f"SELECT sum(d)::BIGINT AS ends, sum(d * s)::BIGINT AS ds, sum(d * s * s)::BIGINT AS dss, sum(s * near)::BIGINT AS cr FROM t_{_s}",
        f"m_{_s}": f"SELECT ends, ds::DOUBLE / ends AS mu, dss::DOUBLE / ends - (ds::DOUBLE / ends) * (ds::DOUBLE / ends) AS var, cr::DOUBLE / ends AS cr FROM q_{_s}",
        f"hv_{_s}": f"SELECT node, s, (s - mu) * (near - d * mu) / (2 * ends * var) AS hv FROM t_{_s}, m_{_s}",
        f"ghv_{_s}": f"SELECT node, s, (s - mu) * (near - d * mu) / (d * var) AS ghv FROM t_{_s}, m_{_s}",
    }
_BASE |= {
    "inner_e": "SELECT x.comm, e.u, e.v FROM edges e JOIN members x ON x.node = e.u JOIN members y ON y.node = e.v AND y.comm = x.comm",
    "eh": "SELECT u, v, (a.s - mu) * (b.s - mu) / (ends / 2.0::DOUBLE * var) AS h_e FROM edges JOIN s1 a ON a.node = u JOIN s1 b ON b.node = v, m_s1",
    "ch": "SELECT c.comm, c.n_members, i.h_c FROM (SELECT comm, count(*) AS n_members FROM members GROUP BY comm) c LEFT JOIN (SELECT comm, avg((a.s - mu) * (b.s - mu)) / max(var) AS h_c FROM inner_e JOIN s1 a ON a.node = u JOIN s1 b ON b.node = v, m_s1 GROUP BY comm) i USING (comm)",
    "tri": "SELECT n.node, coalesce(t.k, 0)::BIGINT AS triangles FROM nodes n LEFT JOIN (SELECT a.u AS node, count(*) // 2 AS k FROM adj a JOIN adj b ON b.u = a.v JOIN adj c ON c.u = b.v AND c.v = a.u GROUP BY a.u) t USING (node)",
    "cc": "SELECT node, degree, CASE WHEN degree >= 2 THEN (2 * triangles)::DOUBLE / (degree * (degree - 1)) END AS clustering FROM tri JOIN deg USING (node)",
    "bcc": "SELECT node, CASE WHEN degree < 2 THEN 0.0::DOUBLE ELSE degree * (1 - clustering) END AS bridgecc FROM cc",
    "two": "SELECT DISTINCT a.u AS node, b.v AS far FROM adj a JOIN adj b ON b.u = a.v WHERE a.u <> b.v AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.u = a.u AND z.v = b.v)",
    "ov": "SELECT node FROM nc WHERE c > 1",
    "onr": "SELECT node, degree, row_number() OVER (ORDER BY degree, node DESC) AS overlap_neigh FROM deg WHERE node IN (SELECT v FROM adj WHERE u IN (SELECT node FROM ov))",
    "iso": "SELECT comm, coalesce(i, 0)::BIGINT AS internal, (ends - 2 * coalesce(i, 0))::BIGINT AS external, CASE WHEN ends - coalesce(i, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(i, 0)::DOUBLE / (ends - coalesce(i, 0)) END AS isolation FROM (SELECT comm, count(*) AS n, sum(degree)::BIGINT AS ends FROM members JOIN deg USING (node) GROUP BY comm HAVING count(*) >= 2) LEFT JOIN (SELECT comm, count(*) AS i FROM inner_e GROUP BY comm) USING (comm)",
    "inter": "SELECT e.u, e.v, x.c * y.c AS w FROM edges e JOIN nc x ON x.node = e.u JOIN nc y ON y.node = e.v WHERE NOT EXISTS (SELECT 1 FROM common z WHERE z.u = e.u AND z.v = e.v)",
    "nn": "SELECT count(*) AS n FROM nodes",
    "rlow": "SELECT 'low_hv' AS strategy, node, row_number() OVER (ORDER BY hv, node) - 1 AS r FROM hv_s1",
    "rbcc": "SELECT 'bridgecc' AS strategy, node, row_number() OVER (ORDER BY bridgecc DESC, node) - 1 AS r FROM bcc",
    "rrand": f"SELECT 'rand_' || rep AS strategy, node, row_number() OVER (PARTITION BY rep ORDER BY md5('12345:' || rep || ':' || node), node) - 1 AS r FROM nodes, range(1, {REPEATS + 1}) g(rep)",
    "ranks": "SELECT * FROM rlow UNION ALL SELECT * FROM rrand",
    "grid": "SELECT DISTINCT least(greatest(round_even(i * 0.02::DOUBLE * n, 0), 0), n)::BIGINT AS k, n FROM nn, range(51) g(i)",
    "dead": "SELECT a.strategy, least(a.r, b.r) AS death, w FROM inter JOIN ranks a ON a.node = u JOIN ranks b ON b.node = v AND b.strategy = a.strategy",
    "curve": "SELECT s.strategy, k, k::DOUBLE / n AS p, coalesce(sum(w) FILTER (WHERE death >= k), 0)::DOUBLE AS value FROM (SELECT DISTINCT strategy FROM ranks) s CROSS JOIN grid LEFT JOIN dead ON dead.strategy = s.strategy GROUP BY s.strategy, k, n",
    "compat": "SELECT 'low_hv' AS strategy, k, k::DOUBLE / n AS p, ((SELECT sum(w) FROM inter) - coalesce((SELECT sum(w) FROM inter JOIN rlow a ON a.node = u JOIN rlow b ON b.node = v WHERE a.r < b.r AND a.r < k), 0))::DOUBLE AS value FROM grid",
    "band": "SELECT k, p, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95 FROM curve WHERE strategy LIKE 'rand_%' GROUP BY k, p",
    "norm": "SELECT k, b.p, c.value / base AS target, p05 / base AS p05, median / base AS median, p95 / base AS p95 FROM band b JOIN (SELECT k, value FROM curve WHERE strategy = 'low_hv') c USING (k), (SELECT median AS base FROM band WHERE k = 0)",
    # removal by steps: the largest component is found from its best-connected survivor
    "st": "SELECT n, greatest(1, round_even(0.01::DOUBLE * n, 0))::BIGINT AS size FROM nn",
    "rr": "SELECT * FROM rlow UNION ALL SELECT * FROM rbcc",
    "live": "SELECT strategy, step::INT AS step, node FROM rr, st, range(11) g(step) WHERE r >= step * size",
    "live_e": "SELECT a.strategy, a.step, e.u, e.v FROM edges e JOIN live a ON a.node = e.u JOIN live b ON b.node = e.v AND b.strategy = a.strategy AND b.step = a.step",
    "live_a": "SELECT strategy, step, u, v FROM live_e UNION ALL SELECT strategy, step, v, u FROM live_e",
    "hub": "SELECT strategy, step, arg_max(u, d * 10000000 - u) AS node FROM (SELECT strategy, step, u, count(*) AS d FROM live_a GROUP BY ALL) GROUP BY strategy, step",
    "reach": "SELECT strategy, step, node FROM hub UNION SELECT a.strategy, a.step, a.v FROM reach r JOIN live_a a ON a.strategy = r.strategy AND a.step = r.step AND a.u = r.node",
    "rho": "SELECT l.strategy, l.step, round_even(1 - l.c::DOUBLE / n, 6) AS removed_frac, x.c::DOUBLE / n AS rho, l.c AS nodes_left, y.c AS edges_left FROM (SELECT strategy, step, count(*) AS c FROM live GROUP BY ALL) l JOIN (SELECT strategy, step, count(*) AS c FROM reach GROUP BY ALL) x USING (strategy, step) JOIN (SELECT strategy, step, count(*) AS c FROM live_e GROUP BY ALL) y USING (strategy, step), nn",
    "comp": "SELECT node, node AS c FROM nodes UNION SELECT a.v, comp.c FROM comp JOIN adj a ON a.u = comp.node WHERE comp.c < a.v",
    "comps": "SELECT node, min(c) AS component FROM comp GROUP BY node",
    "big": "SELECT component FROM comps GROUP BY component ORDER BY count(*) DESC, component LIMIT 1",
    "hs": "SELECT k, 2 * count(*) AS n, sum(a.s + b.s) AS t, sum(a.s * a.s + b.s * b.s) AS q, 2 * sum(a.s * b.s) AS x, any_value(grid.n) AS nv FROM grid JOIN edges ON true JOIN rlow ra ON ra.node = u JOIN rlow rb ON rb.node = v JOIN s1 a ON a.node = u JOIN s1 b ON b.node = v WHERE least(ra.r, rb.r) >= k GROUP BY k",
    "hc": "SELECT 'low_hv' AS strategy, 'homophily' AS metric, grid.k::DOUBLE / grid.n AS fraction_removed, CASE WHEN hs.n * q - t * t <> 0 THEN (hs.n * x - t * t)::DOUBLE / (hs.n * q - t * t)::DOUBLE END AS metric_value FROM grid LEFT JOIN hs USING (k)",
    "qs": "SELECT quantile_cont(degree, 0.25) AS a, quantile_cont(degree, 0.5) AS b, quantile_cont(degree, 0.75) AS c FROM deg",
    "quart": "SELECT node, degree, CASE WHEN degree <= a THEN 'Q1' WHEN degree <= b THEN 'Q2' WHEN degree <= c THEN 'Q3' ELSE 'Q4' END AS bin FROM deg, qs",
    "taus": "SELECT t.tau, t.m FROM (VALUES (0.0::DOUBLE, 0), (0.1::DOUBLE, 100), (0.2::DOUBLE, 200), (0.3::DOUBLE, 300)) t(tau, m)",
    "pairs": "SELECT e.u, e.v, coalesce(z.i, 0) AS i, x.c + y.c AS t FROM edges e JOIN nc x ON x.node = e.u JOIN nc y ON y.node = e.v LEFT JOIN common z ON z.u = e.u AND z.v = e.v",
    "idt": "SELECT tau, n.node, coalesce(count(h.u), 0)::BIGINT AS inter_deg FROM taus CROSS JOIN nodes n LEFT JOIN (SELECT u, v, i, t FROM pairs UNION ALL SELECT v, u, i, t FROM pairs) h ON h.u = n.node AND CASE WHEN m = 0 THEN h.i = 0 ELSE 1000 * h.i < m * (h.t - h.i) END GROUP BY tau, n.node",
    "kk": "SELECT greatest(1, round_even(0.1::DOUBLE * n, 0))::BIGINT AS k FROM nn",
    "sets": "SELECT 'hv_s1' AS strategy, node, r AS place FROM rlow, kk WHERE r < k UNION ALL SELECT 'bridgecc', node, r FROM rbcc, kk WHERE r < k",
    "obs": "SELECT tau, strategy, sum(inter_deg)::DOUBLE / sum(degree) AS ier_stub, avg(inter_deg::DOUBLE / greatest(1, degree)) AS ier_node_mean, count(*) AS n_selected FROM sets JOIN quart USING (node) JOIN idt USING (node) GROUP BY tau, strategy",
    "draws": f"SELECT strategy, rep, ('0x' || substr(md5('42:boot:' || strategy || ':' || rep || ':' || j), 1, 12))::BIGINT % k AS place FROM (VALUES ('hv_s1'), ('bridgecc')) s(strategy), kk, range(1, {BOOT + 1}) g(rep), range(1, 100000) h(j) WHERE j <= k",
    "breps": "SELECT tau, strategy, rep, sum(inter_deg)::DOUBLE / sum(degree) AS stub, avg(inter_deg::DOUBLE / greatest(1, degree)) AS nm FROM draws JOIN sets USING (strategy, place) JOIN quart USING (node) JOIN idt USING (node) GROUP BY tau, strategy, rep",
    "boot": "SELECT tau, strategy, quantile_cont(stub, 0.025) AS stub_low, quantile_cont(stub, 0.975) AS stub_high, quantile_cont(nm, 0.025) AS nm_low, quantile_cont(nm, 0.975) AS nm_high FROM breps GROUP BY tau, strategy",
    "needs": "SELECT strategy, bin, count(*) AS need FROM sets JOIN quart USING (node) GROUP BY strategy, bin",
    "perm": f"SELECT strategy, rep, node, degree FROM (SELECT strategy, rep, node, degree, need, row_number() OVER (PARTITION BY strategy, rep, bin ORDER BY md5('42:perm:' || strategy || ':' || rep || ':' || node), node) AS place FROM quart JOIN needs USING (bin), range(1, {PERM + 1}) g(rep)) WHERE place <= need",
    "nulls": "SELECT tau, strategy, rep, sum(inter_deg)::DOUBLE / sum(degree) AS stub, avg(inter_deg::DOUBLE / greatest(1, degree)) AS nm FROM perm JOIN idt USING (node) GROUP BY tau, strategy, rep",
    "long_n": "SELECT tau, strategy, rep, 'stub' AS what, stub AS x FROM nulls UNION ALL SELECT tau, strategy, rep, 'nm', nm FROM nulls",
    "long_o": "SELECT tau, strategy, 'stub' AS what, ier_stub AS o FROM obs UNION ALL SELECT tau, strategy, 'nm', ier_node_mean FROM obs",
    "mids": "SELECT tau, strategy, what, median(x) AS mid FROM long_n GROUP BY ALL",
    "pv": "SELECT tau, strategy, what, least(1.0, (count(*) FILTER (WHERE x >= o - 1e-12::DOUBLE) + 1)::DOUBLE / (count(*) + 1)) AS one, least(1.0, (count(*) FILTER (WHERE abs(x - mid) >= abs(o - mid) - 1e-12::DOUBLE) + 1)::DOUBLE / (count(*) + 1)) AS two FROM long_n JOIN long_o USING (tau, strategy, what) JOIN mids USING (tau, strategy, what) GROUP BY ALL",
    "pp": "SELECT tau, strategy, max(one) FILTER (WHERE what = 'stub') AS p_stub_one, max(two) FILTER (WHERE what = 'stub') AS p_stub_two, max(one) FILTER (WHERE what = 'nm') AS p_nm_one, max(two) FILTER (WHERE what = 'nm') AS p_nm_two FROM pv GROUP BY tau, strategy",
    "summ": f"SELECT 'fixture' AS dataset, tau, strategy, ier_node_mean, nm_low AS ier_node_mean_ci_low, nm_high AS ier_node_mean_ci_high, p_nm_two AS p_perm_nm, ier_stub, stub_low AS ier_stub_ci_low, stub_high AS ier_stub_ci_high, p_stub_two AS p_perm_stub, n_selected, {PERM}::INT AS k_permutations FROM obs JOIN boot USING (tau, strategy) JOIN pp USING (tau, strategy)",
    "dn": "SELECT a.tau, a.what, a.rep, a.x - b.x AS x FROM long_n a JOIN long_n b USING (tau, what, rep) WHERE a.strategy = 'hv_s1' AND b.strategy = 'bridgecc'",
    "dob": "SELECT a.tau, a.what, a.o - b.o AS o FROM long_o a JOIN long_o b USING (tau, what) WHERE a.strategy = 'hv_s1' AND b.strategy = 'bridgecc'",
    "dmid": "SELECT tau, what, median(x) AS mid FROM dn GROUP BY ALL",
    "dp": "SELECT tau, what, max(o) AS o, least(1.0, (count(*) FILTER (WHERE x >= o - 1e-12::DOUBLE) + 1)::DOUBLE / (count(*) + 1)) AS one, least(1.0, (count(*) FILTER (WHERE abs(x - mid) >= abs(o - mid) - 1e-12::DOUBLE) + 1)::DOUBLE / (count(*) + 1)) AS two FROM dn JOIN dob USING (tau, what) JOIN dmid USING (tau, what) GROUP BY tau, what",
    "fr": "SELECT 'fixture' AS dataset, a.ier_node_mean AS nm_hv, b.ier_node_mean AS nm_br, a.ier_node_mean - b.ier_node_mean AS d, sqrt(pow((a.ier_node_mean_ci_high - a.ier_node_mean_ci_low) / 2, 2) + pow((b.ier_node_mean_ci_high - b.ier_node_mean_ci_low) / 2, 2)) AS h FROM summ a JOIN summ b USING (tau) WHERE abs(tau - 0.3) < 5e-4 AND a.strategy = 'hv_s1' AND b.strategy = 'bridgecc'",
    "gn": "SELECT node FROM comps WHERE component = (SELECT component FROM big)",
    "gdesc": "SELECT 'fixture' AS dataset, n, e, round_even(2 * e::DOUBLE / n, 2) AS mean_degree, round_even(e / (n * (n - 1) / 2.0::DOUBLE), 5) AS density, n_comms, round_even(ms::DOUBLE / n_in, 2) AS mean_m, max_m, round_even(ms::DOUBLE / n_comms, 2) AS avg_comm_size, max_c AS max_comm_size, round_even(n_in::DOUBLE / n, 4) AS prop_nodes_in_comms, round_even(n_ov::DOUBLE / n_in, 4) AS prop_overlapped, round_even(n_ov::DOUBLE / n, 4) AS prop_overlapped_all, r, avg_clustering, h_s1 FROM (SELECT count(*) AS n FROM gn), (SELECT count(*) AS e FROM edges WHERE u IN (FROM gn) AND v IN (FROM gn)), (SELECT count(*) AS n_in, sum(c)::BIGINT AS ms, max(c) AS max_m, count(*) FILTER (WHERE c > 1) AS n_ov FROM nc WHERE node IN (FROM gn)), (SELECT count(*) AS n_comms, max(c) AS max_c FROM (SELECT count(*) AS c FROM members WHERE node IN (FROM gn) GROUP BY comm)), (SELECT round_even((cr - mu * mu) / var, 4) AS r FROM m_s0), (SELECT round_even(avg(clustering), 4) AS avg_clustering FROM cc), (SELECT round_even((cr - mu * mu) / var, 4) AS h_s1 FROM m_s1)",
}
_RECURSIVE = {"comp", "reach"}

_FINAL = {
    "edges_canonical": "SELECT u, v FROM edges",
    "adjacency": "SELECT u, v FROM adj",
    "degree": "SELECT node, degree FROM deg",
    "members_by_node": "SELECT node, string_agg(comm::VARCHAR, ',' ORDER BY comm) AS comms FROM members GROUP BY node",
    **{f"scalar_{s}": f"SELECT node, s FROM {s}" for s in ("s0", "s1", "s2", "s3", "s4")},
    **{f"hv_{s}": f"SELECT node, s, hv FROM hv_{s}" for s in ("s0", "s1", "s2", "s3")},
    **{f"ghv_{s}": f"SELECT node, s, ghv FROM ghv_{s}" for s in ("s1", "s2")},
    "assortativity_s1": "SELECT corr(a.s, b.s) AS r FROM adj JOIN s1 a ON a.node = u JOIN s1 b ON b.node = v",
    "assortativity_degree": "SELECT corr(a.s, b.s) AS r FROM adj JOIN s0 a ON a.node = u JOIN s0 b ON b.node = v",
    "edge_homophily": "SELECT u, v, h_e FROM eh",
    "community_homophily": "SELECT comm, n_members, h_c FROM ch",
    "community_homophily_summary": "SELECT sum(coalesce(h_c * n_members, 0)) / sum(n_members) AS hc_weighted, count(*) AS n_communities FROM ch",
    "triangles": "SELECT node, triangles FROM tri",
    "local_clustering": "SELECT node, degree, clustering FROM cc",
    "bridgecc": "SELECT node, bridgecc FROM bcc",
    "collective_influence_r1": "SELECT n.node, ((n.degree - 1) * sum(m.degree - 1))::BIGINT AS ci FROM deg n JOIN adj ON u = n.node JOIN deg m ON m.node = v GROUP BY n.node, n.degree",
    "collective_influence_r2": "SELECT n.node, ((n.degree - 1) * coalesce(sum(m.degree - 1), 0))::BIGINT AS ci FROM deg n LEFT JOIN two ON two.node = n.node LEFT JOIN deg m ON m.node = two.far GROUP BY n.node, n.degree",
    "overlapping_nodes": "SELECT node FROM ov",
    "overlap_neigh": "SELECT node, degree, overlap_neigh FROM onr",
    "num_communities": "SELECT node, c AS num_communities FROM nodes LEFT JOIN nc USING (node)",
    "delta_hv": "SELECT node, a.hv - b.hv AS delta_hv, abs(a.hv - b.hv) AS abs_delta_hv FROM hv_s1 a JOIN hv_s0 b USING (node)",
    "community_isolation": "SELECT comm, internal, external, isolation FROM iso",
    "mean_isolation": "SELECT avg(isolation) AS isolation, count(*) AS n_communities FROM iso",
    "internal_edge_density": "SELECT comm, n, coalesce(i, 0) / (n * (n - 1) / 2.0::DOUBLE) AS density FROM (SELECT comm, count(*) AS n FROM members GROUP BY comm HAVING count(*) >= 2) LEFT JOIN (SELECT comm, count(*) AS i FROM inner_e GROUP BY comm) USING (comm)",
    "connected_components": "SELECT node, component FROM comps",
    "giant_component": "SELECT node FROM gn",
    "induced_subgraph": "SELECT u, v FROM edges JOIN deg a ON a.node = u JOIN deg b ON b.node = v WHERE a.degree >= 10 AND b.degree >= 10",
    "inter_edges": "SELECT u, v, w FROM inter",
    "w_inter_total": "SELECT sum(w)::BIGINT AS w0, count(*) AS n_inter FROM inter",
    "inter_edge_sample": "SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY md5('12345:' || u || ':' || v), u, v) AS r FROM edges) WHERE r <= (SELECT greatest(1, round_even(0.1::DOUBLE * count(*), 0)) FROM edges)",
    "w_inter_curve_low_hv": "SELECT strategy, k, p, value FROM curve WHERE strategy = 'low_hv'",
    "w_inter_curve_random": "SELECT strategy, k, p, value FROM curve WHERE strategy <> 'low_hv'",
    "w_inter_curve_compat": "SELECT strategy, k, p, value FROM compat",
    "w_inter_band": "SELECT k, p, p05, median, p95 FROM band",
    "w_inter_normalized": "SELECT k, p, target, p05, median, p95 FROM norm",
    "w_inter_auc": "SELECT sum(a) AS auc_difference, -sum(a) AS auc_depletion FROM (SELECT (p - lag(p) OVER (ORDER BY k)) * ((target - median) + lag(target - median) OVER (ORDER BY k)) / 2 AS a FROM norm)",
    "w_inter_p_sep": "SELECT min(p) AS p_sep FROM (SELECT p, sum((target < p05)::INT) OVER (ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM norm) WHERE n = 3",
    "rho_gcc_trajectory": "SELECT strategy, step, removed_frac, rho, nodes_left, edges_left FROM rho",
    "rho_gcc_summary": "SELECT strategy, step / 100.0::DOUBLE AS p, rho FROM rho WHERE step IN (5, 10)",
    "h_curve": "SELECT strategy, metric, fraction_removed, metric_value FROM hc",
    "h_hat_curve": "SELECT fraction_removed AS p, metric_value AS h, metric_value / (SELECT arg_min(metric_value, fraction_removed) FROM hc WHERE metric_value IS NOT NULL) AS h_hat FROM hc WHERE metric_value IS NOT NULL AND fraction_removed <= 0.9",
    "s_cut_marker": "SELECT count(*) AS n_cut, avg(x) AS s_mean, median(x) AS s_median, stddev_samp(x) AS s_std FROM (SELECT coalesce(c, 0)::DOUBLE / degree AS x FROM rlow JOIN deg USING (node) LEFT JOIN (SELECT node, count(*) AS c FROM (SELECT u AS node FROM inter UNION ALL SELECT v FROM inter) GROUP BY node) USING (node), nn WHERE r < greatest(1, round_even(0.01::DOUBLE * n, 0)))",
    "overlap_summary": "SELECT avg(s) AS m_mean, avg((s > 1)::INT) AS psi FROM s2",
    "degree_quartiles": "SELECT node, degree, bin FROM quart",
    "inter_degree_tau": "SELECT tau, node, inter_deg FROM idt",
    "ier_targets": "SELECT strategy, node, place FROM sets",
    "ier_observed": "SELECT tau, strategy, ier_stub, ier_node_mean, n_selected FROM obs",
    "ier_by_degree_bin": "SELECT tau, strategy, bin, sum(inter_deg)::DOUBLE / sum(degree) AS ier_stub, avg(inter_deg::DOUBLE / greatest(1, degree)) AS ier_node_mean, count(*) AS n_selected FROM sets JOIN quart USING (node) JOIN idt USING (node) GROUP BY tau, strategy, bin",
    "ier_bootstrap_ci": "SELECT * FROM boot",
    "ier_permutation_p": "SELECT * FROM pp",
    "ier_summary": "SELECT * FROM summ",
    "ier_deltas": "SELECT 'fixture' AS dataset, tau, max(o) FILTER (WHERE what = 'nm') AS delta_ier_node_mean, max(two) FILTER (WHERE what = 'nm') AS p_perm_nm_delta, max(o) FILTER (WHERE what = 'stub') AS delta_ier_stub, max(two) FILTER (WHERE what = 'stub') AS p_perm_stub_delta FROM dp GROUP BY tau",
    "ier_forest": "SELECT dataset, 100 * d AS delta_pp, 100 * (d - h) AS ci_low_pp, 100 * (d + h) AS ci_high_pp, nm_hv, nm_br FROM fr",
    "unified_metrics": "SELECT node, a.hv AS hv_s1, a.s AS s1, b.ghv AS ghv_s2, b.s AS s2 FROM hv_s1 a JOIN ghv_s2 b USING (node)",
    "all_metrics": "SELECT node, a.hv AS hv_s1, a.s AS s1, b.hv AS hv_s0, b.s AS s0, bridgecc, deg.degree, c AS num_communities, overlap_neigh, a.hv - b.hv AS delta_hv, abs(a.hv - b.hv) AS abs_delta_hv FROM hv_s1 a JOIN hv_s0 b USING (node) JOIN bcc USING (node) JOIN deg USING (node) LEFT JOIN nc USING (node) LEFT JOIN onr USING (node)",
    "global_metrics": "SELECT * FROM gdesc",
    "dataset_descriptives": "SELECT * EXCLUDE (avg_comm_size, max_comm_size) FROM gdesc",
    "network_check": "SELECT (SELECT max(node) + 1 FROM nodes) AS n_ids, n AS n_nodes, (SELECT max(node) + 1 FROM nodes) - n AS n_isolated, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT component) FROM comps) AS n_components, (SELECT count(*) FROM gn) AS giant_size, 0::BIGINT AS n_self_loops, false AS has_self_loops, 0::BIGINT AS n_multiedges, false AS has_multiedges, 0::BIGINT AS n_outside FROM nn",
    "separation_metrics": "SELECT 'fixture' AS dataset, 'Fixture' AS name, 'low_hv' AS target_strategy, (SELECT min(p) FROM (SELECT p, sum((target < p05)::INT) OVER (ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM norm) WHERE n = 3) AS p_separation, (SELECT sum(a) FROM (SELECT (p - lag(p) OVER (ORDER BY k)) * ((target - median) + lag(target - median) OVER (ORDER BY k)) / 2 AS a FROM norm)) AS AUC_difference, -(SELECT sum(a) FROM (SELECT (p - lag(p) OVER (ORDER BY k)) * ((target - median) + lag(target - median) OVER (ORDER BY k)) / 2 AS a FROM norm)) AS AUC_depletion",
    "ier_by_degree_rows": "SELECT 'fixture' AS dataset, tau, strategy, bin AS degree_bin, count(*) AS n_nodes, sum(inter_deg)::BIGINT AS sum_inter_deg, sum(degree)::BIGINT AS sum_deg, avg(inter_deg::DOUBLE / greatest(1, degree)) AS IER_node_mean, sum(inter_deg)::DOUBLE / sum(degree) AS IER_stub FROM sets JOIN quart USING (node) JOIN idt USING (node) GROUP BY tau, strategy, bin",
    "ier_legacy": "SELECT 'fixture' AS dataset, tau, strategy, n_selected AS k, ier_stub AS IER_stub, stub_low AS IER_stub_ci_low, stub_high AS IER_stub_ci_high, ier_node_mean AS IER_node_mean, nm_low AS IER_nm_ci_low, nm_high AS IER_nm_ci_high, p_stub_one AS p_one_stub, p_stub_two AS p_two_stub, p_nm_one AS p_one_nm, p_nm_two AS p_two_nm FROM obs JOIN boot USING (tau, strategy) JOIN pp USING (tau, strategy)"
    " UNION ALL SELECT 'fixture', tau, 'delta(hv-bridgecc)', (SELECT max(n_selected) FROM obs), max(o) FILTER (WHERE what = 'stub'), NULL, NULL, max(o) FILTER (WHERE what = 'nm'), NULL, NULL, max(one) FILTER (WHERE what = 'stub'), max(two) FILTER (WHERE what = 'stub'), max(one) FILTER (WHERE what = 'nm'), max(two) FILTER (WHERE what = 'nm') FROM dp GROUP BY tau",
    "hc_metrics": "SELECT comm, h_c AS hc_s1, n_members AS num_nodes, (SELECT corr(a.s, b.s) FROM adj JOIN s1 a ON a.node = u JOIN s1 b ON b.node = v) AS h_global FROM ch",
    "hc_summary": "SELECT 'fixture' AS dataset, sum(coalesce(h_c * n_members, 0)) / sum(n_members) AS hc_weighted, (SELECT corr(a.s, b.s) FROM adj JOIN s1 a ON a.node = u JOIN s1 b ON b.node = v) AS h_global, count(*) AS n_communities FROM ch",
    "he_metrics": "SELECT row_number() OVER (ORDER BY u, v) - 1 AS edge_id, u AS node_1, v AS node_2, h_e AS he_s1, a.s AS s1_node1, b.s AS s1_node2 FROM eh JOIN s1 a ON a.node = u JOIN s1 b ON b.node = v",
    "sensitivity_markers": "SELECT 'fixture' AS dataset, 0.01::DOUBLE AS p0, avg(x) AS S_cut_mean, median(x) AS S_cut_median, stddev_samp(x) AS S_cut_std, (SELECT avg(s) FROM s2) AS m_mean, (SELECT avg((s > 1)::INT) FROM s2) AS psi, max(n) AS n, (SELECT count(*) FROM edges) AS e, (SELECT arg_max(metric_value, fraction_removed) / arg_min(metric_value, fraction_removed) FROM hc WHERE metric_value IS NOT NULL AND fraction_removed <= 0.01) AS h_hat_p0 FROM (SELECT coalesce(c, 0)::DOUBLE / degree AS x, n FROM rlow JOIN deg USING (node) LEFT JOIN (SELECT node, count(*) AS c FROM (SELECT u AS node FROM inter UNION ALL SELECT v FROM inter) GROUP BY node) USING (node), nn WHERE r < greatest(1, round_even(0.01::DOUBLE * n, 0)))",
    "rho_summary_all": "SELECT 'fixture' AS dataset, strategy, step / 100.0::DOUBLE AS p, rho AS rho_GCC FROM rho WHERE step IN (5, 10)",
    "hv_resumed": "SELECT node, b.hv AS hv_s0, b.s AS s0, a.hv AS hv_s1, a.s AS s1 FROM hv_s1 a JOIN hv_s0 b USING (node)",
    "name_dictionary": "SELECT row_number() OVER (ORDER BY name) - 1 AS node, name FROM (SELECT 'part-' || node AS name FROM nodes UNION SELECT 'part-' || node FROM members)",
    "named_hv_metrics": "SELECT 'part-' || node AS node, s, hv FROM hv_s1",
    "project_metrics": "SELECT 'part-' || node AS node, hv AS hv_s1, s AS s1, bridgecc, degree, c AS num_communities FROM hv_s1 JOIN bcc USING (node) JOIN deg USING (node) LEFT JOIN nc USING (node)",
    "misaligned_ids": "SELECT node, 'network' AS side, count(*) AS rows FROM members WHERE node NOT IN (SELECT node FROM nodes) GROUP BY node UNION ALL SELECT node, 'communities', degree FROM deg WHERE node NOT IN (SELECT node FROM members)",
    "edge_styles": "SELECT u, v, h_e, CASE WHEN abs(h_e) <= 1e-6 THEN 'neutral' WHEN h_e > 0 THEN 'positive' ELSE 'negative' END AS class, abs(h_e) / (SELECT max(abs(h_e)) FROM eh) AS width FROM eh",
}


def _needs(sql: str, found: dict[str, bool]) -> None:
    """The named tables that a statement reads, each after those that it reads itself."""
    for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)\b", sql)):
        if word in _BASE and word not in found:
            found[word] = False
            _needs(_BASE[word], found)
            del found[word]
            found[word] = True


def _whole(final: str) -> str:
    """The statement with the tables that it needs, and every double rounded as the queries' are."""
    names: dict[str, bool] = {}
    _needs(final, names)
    tables = ", ".join(f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({_BASE[n]})" for n in names)
    return f"WITH RECURSIVE {tables} {final}"


#: Doubles of each result; they are rounded as the queries' are.
_DOUBLES = {
    "hv_s0": ["hv"],
    "hv_s1": ["hv"],
    "hv_s2": ["hv"],
    "hv_s3": ["hv"],
    "ghv_s1": ["ghv"],
    "ghv_s2": ["ghv"],
    "assortativity_s1": ["r"],
    "assortativity_degree": ["r"],
    "edge_homophily": ["h_e"],
    "community_homophily": ["h_c"],
    "community_homophily_summary": ["hc_weighted"],
    "local_clustering": ["clustering"],
    "bridgecc": ["bridgecc"],
    "delta_hv": ["delta_hv", "abs_delta_hv"],
    "community_isolation": ["isolation"],
    "mean_isolation": ["isolation"],
    "internal_edge_density": ["density"],
    "w_inter_curve_low_hv": ["p", "value"],
    "w_inter_curve_random": ["p", "value"],
    "w_inter_curve_compat": ["p", "value"],
    "w_inter_band": ["p", "p05", "median", "p95"],
    "w_inter_normalized": ["p", "target", "p05", "median", "p95"],
    "w_inter_auc": ["auc_difference", "auc_depletion"],
    "w_inter_p_sep": ["p_sep"],
    "rho_gcc_trajectory": ["removed_frac", "rho"],
    "rho_gcc_summary": ["p", "rho"],
    "h_curve": ["fraction_removed", "metric_value"],
    "h_hat_curve": ["p", "h", "h_hat"],
    "s_cut_marker": ["s_mean", "s_median", "s_std"],
    "overlap_summary": ["m_mean", "psi"],
    "inter_degree_tau": ["tau"],
    "ier_observed": ["tau", "ier_stub", "ier_node_mean"],
    "ier_by_degree_bin": ["tau", "ier_stub", "ier_node_mean"],
    "ier_bootstrap_ci": ["tau", "stub_low", "stub_high", "nm_low", "nm_high"],
    "ier_permutation_p": ["tau", "p_stub_one", "p_stub_two", "p_nm_one", "p_nm_two"],
    "ier_summary": ["tau", "ier_node_mean", "ier_node_mean_ci_low", "ier_node_mean_ci_high", "p_perm_nm", "ier_stub", "ier_stub_ci_low", "ier_stub_ci_high", "p_perm_stub"],
    "ier_deltas": ["tau", "delta_ier_node_mean", "p_perm_nm_delta", "delta_ier_stub", "p_perm_stub_delta"],
    "ier_forest": ["delta_pp", "ci_low_pp", "ci_high_pp", "nm_hv", "nm_br"],
    "unified_metrics": ["hv_s1", "ghv_s2"],
    "all_metrics": ["hv_s1", "hv_s0", "bridgecc", "delta_hv", "abs_delta_hv"],
    "global_metrics": ["mean_degree", "density", "mean_m", "avg_comm_size", "prop_nodes_in_comms", "prop_overlapped", "prop_overlapped_all", "r", "avg_clustering", "h_s1"],
    "dataset_descriptives": ["mean_degree", "density", "mean_m", "prop_nodes_in_comms", "prop_overlapped", "prop_overlapped_all", "r", "avg_clustering", "h_s1"],
    "separation_metrics": ["p_separation", "AUC_difference", "AUC_depletion"],
    "ier_by_degree_rows": ["tau", "IER_node_mean", "IER_stub"],
    "ier_legacy": ["tau", "IER_stub", "IER_stub_ci_low", "IER_stub_ci_high", "IER_node_mean", "IER_nm_ci_low", "IER_nm_ci_high", "p_one_stub", "p_two_stub", "p_one_nm", "p_two_nm"],
    "hc_metrics": ["hc_s1", "h_global"],
    "hc_summary": ["hc_weighted", "h_global"],
    "he_metrics": ["he_s1"],
    "sensitivity_markers": ["S_cut_mean", "S_cut_median", "S_cut_std", "m_mean", "psi", "h_hat_p0"],
    "rho_summary_all": ["p", "rho_GCC"],
    "hv_resumed": ["hv_s0", "hv_s1"],
    "edge_styles": ["h_e", "width"],
    "named_hv_metrics": ["hv"],
    "project_metrics": ["hv_s1", "bridgecc"],
}
#: Results of several graphs at once, from those of each alone.
_DATASETS = {
    "hv_s1_datasets": ("SELECT node, s, hv FROM hv_s1", ["hv"]),
    "assortativity_datasets": ("SELECT corr(a.s, b.s) AS r FROM adj JOIN s1 a ON a.node = u JOIN s1 b ON b.node = v", ["r"]),
    "components_datasets": ("SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT component) FROM comps) AS n_components, component AS giant, (SELECT count(*) FROM comps c WHERE c.component = big.component) AS giant_size FROM big", []),
    "w_inter_curve_datasets": ("SELECT strategy, k, p, value FROM curve WHERE strategy IN ('low_hv', 'rand_1', 'rand_2')", ["p", "value"]),
    "ier_observed_datasets": ("SELECT tau, strategy, ier_stub, ier_node_mean, n_selected FROM obs", ["tau", "ier_stub", "ier_node_mean"]),
    "ier_summary_datasets": ("SELECT * EXCLUDE (dataset) FROM summ", ["tau", "ier_node_mean", "ier_node_mean_ci_low", "ier_node_mean_ci_high", "p_perm_nm", "ier_stub", "ier_stub_ci_low", "ier_stub_ci_high", "p_perm_stub"]),
}


def _rounded(name: str) -> str:
    own = _DOUBLES.get(name)
    return f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, 10) AS {c}' for c in own)}) FROM ({_FINAL[name]})" if own else _FINAL[name]


def _each(final: str, doubles: list[str]) -> str:
    """The statement over the graph of each return flag, one after the other."""
    whole = _whole(f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, 10) AS {c}' for c in doubles)}) FROM ({final})" if doubles else final)
    return " UNION ALL ".join("SELECT '{0}' AS dataset, * FROM ({1})".format(flag, whole.replace("l_returnflag = 'R'", f"l_returnflag = '{flag}'")) for flag in "ANR")


ORACLES: dict[str, str] = {name: _whole(_rounded(name)) for name in _FINAL} | {name: _each(*final) for name, final in _DATASETS.items()}
