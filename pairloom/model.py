"""Tables of the data model. A graph is its edges, in both directions, beside its vertices; no row is no edge."""

from __future__ import annotations

FACT = "scenario string, strategy string, algorithm string, seed_count int, trial int, accuracy double, cpu_seconds double"
RECORD = "strategy string, trial int, H0 double, final_unseeded double, final_all double, alpha0 double, step_toward_Q0 double, n_iter int"
