"""Windows whose mean is just at the limit."""

import random

from framewise.operators.chunks import corrupted_chunks
from framewise.plans.series import EVENT_CORRUPTION


def test_a_mean_at_the_limit_passes_in_any_order(spark):
    """Twenty values of two decimals that add up to 1000.00, of which some orders of adding give less; one cent less does not pass."""
    rng, rows = random.Random(1), []
    for run in range(300):
        cents = [rng.randrange(5000, 9000) for _ in range(10)] + [rng.randrange(1000, 3000) for _ in range(9)]
        cents += [100_000 - sum(cents) - (run >= 200)]
        if not 0 <= cents[-1] < 50_000:
            continue
        rows += [(run, vol, c / 100) for vol, c in enumerate(cents)]
    found = corrupted_chunks(spark.createDataFrame(rows, "run_key int, vol int, fd double"), ["run_key"], "vol", "fd", EVENT_CORRUPTION).collect()
    assert {r.run_key for r in found} == {run for run, *_ in rows if run < 200} and {r.chunk_mean_fd for r in found} == {50.0}
