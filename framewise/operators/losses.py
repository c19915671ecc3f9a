"""Loss terms as aggregates over pairs of arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from framewise.functions.arrays import l1, mse


@dataclass(frozen=True)
class LossWeights:
    adversarial: float = 1.0
    cycle: float = 10.0
    identity: float = 5.0
    content: float = 1.0
    artefact: float = 0.1


#: The weights that training runs use by default.
RUN_WEIGHTS = LossWeights(1.0, 20.0, 20.0, 0.5, 0.1)


def discriminator(real: Column, fake: Column) -> Column:
    """Least squares: real scores to 1, fake ones to 0, halved."""
    return 0.5 * mse(real, 1.0) + 0.5 * mse(fake, 0.0)


def generator(fake_a: Column, fake_b: Column) -> Column:
    return 0.5 * mse(fake_a, 1.0) + 0.5 * mse(fake_b, 1.0)


def two_sided_l1(a: Column, a2: Column, b: Column, b2: Column) -> Column:
    """Cycle and identity terms: both domains' mean absolute errors."""
    return l1(a, a2) + l1(b, b2)


def content(a: Column, a2: Column, b: Column, b2: Column) -> Column:
    return mse(a, a2) + mse(b, b2)


def artefact(global_code: Column, spatial_code: Column) -> Column:
    return mse(global_code, 0.0) + mse(spatial_code, 0.0)


def weighted_total(adv: Column, cyc: Column, idt: Column, con: Column, art: Column, w: LossWeights = LossWeights()) -> Column:
    return w.adversarial * adv + w.cycle * cyc + w.identity * idt + w.content * con + w.artefact * art
