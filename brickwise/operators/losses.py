"""Masked losses as aggregates (forward values only): columns for ``agg`` over a sample or a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickwise.operators.aggregates import masked_mean

EPS = 1e-6


def soft_dice(a: Column, b: Column, mask: Column, eps: float = EPS) -> Column:
    """1 - (2 <a, b> + eps) / (<a, a> + <b, b> + eps) over the mask."""
    return 1 - (2 * F.sum(a * b * mask) + eps) / (F.sum(a * a * mask) + F.sum(b * b * mask) + eps)


def band_dice(a: Column, b: Column, mask: Column, tau: float = 2.0) -> Column:
    """Soft Dice of the bands exp(-|distance| / tau) of two signed distances."""
    return soft_dice(F.exp(-F.abs(a) / tau), F.exp(-F.abs(b) / tau), mask)


def bce(logit: Column, target: Column, mask: Column, positive_weight: float = 1.0) -> Column:
    """Masked mean of the binary cross entropy of logits, in the form that can't overflow."""
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return masked_mean((1 - target) * logit + (1 + (positive_weight - 1) * target) * soft, mask)


def positive_weight(target: Column, mask: Column, low: float = 1.0, high: float = 50.0) -> Column:
    """Soft mass of the negatives over that of the positives (at least 1), within bounds."""
    ratio = F.sum((1 - target) * mask) / F.greatest(F.sum(target * mask), F.lit(1.0))
    return F.greatest(F.lit(low), F.least(F.lit(high), ratio))


def huber(a: Column, b: Column, mask: Column, delta: float = 1.0) -> Column:
    d = F.abs(a - b)
    return masked_mean(F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta)), mask)


def l1(a: Column, b: Column, mask: Column, scale: float = 1.0) -> Column:
    return masked_mean(F.abs(a - b) / scale, mask)


def surface_weighted_l1(a: Column, b: Column, mask: Column, sigma: float = 4.0) -> Column:
    """L1 weighted by a gaussian of the target's distance, over the weights' sum."""
    weight = mask * F.exp(-0.5 * (b / sigma) * (b / sigma))
    return F.sum(weight * F.abs(a - b)) / F.greatest(F.sum(weight), F.lit(1.0))


def axial(dot: Column, weight: Column) -> Column:
    """Weighted mean of 1 - cos^2 of two lines."""
    return masked_mean(1 - dot * dot, weight)


def swap_invariant(straight: Column, swapped: Column) -> Column:
    """The cheaper of two assignments of two faces."""
    return F.least(straight, swapped)


#: Weight that the surface terms give to the target's zero set beyond 1, and the width of the gaussian around it, in voxels. Fixed values.
PEAK, WIDTH = 8.0, 4.0


def peaked_l1(prediction: Column, target: Column, mask: Column) -> Column:
    """Masked mean of the absolute difference, weighted most where the target's distance is near zero."""
    weight = 1 + PEAK * F.exp(-(target * target) / (2 * WIDTH * WIDTH))
    return masked_mean(weight * F.abs(prediction - target), mask)


def surface_terms(prediction: Column, target: Column, logit: Column, valid: Column) -> dict[str, Column]:
    """Terms of one signed distance: weighted L1 and band Dice where supervised, and the validity's cross entropy where it isn't ignored."""
    supervised, known = (valid == 1).cast("double"), (valid != 2).cast("double")
    return {"sdf_l1": peaked_l1(prediction, target, supervised), "band_dice": band_dice(prediction, target, supervised), "valid_bce": bce(logit, supervised,
        known)}


def sides_terms(distance: Column, body_logit: Column, valid_logit: Column, target: Column, body: Column, valid: Column) -> dict[str, Column]:
    """Terms of an unsigned distance to the nearest face and of the side: weighted L1, band Dice, and cross entropy and soft Dice of the body."""
    supervised, known = (valid == 1).cast("double"), (valid != 2).cast("double")
    share = 1 / (1 + F.exp(-body_logit))
    return {
        "sdf_l1": peaked_l1(distance, target, supervised), "band_dice": band_dice(distance, target, supervised), "body_bce": bce(body_logit, body, supervised),
        "body_dice": soft_dice(share, body, supervised), "valid_bce": bce(valid_logit, supervised, known),
    }


def descriptor_terms(offset: list[tuple[Column, Column]], thickness: tuple[Column, Column], logit: Column, incoherence: Column, valid: Column,
    limit: float = 20.0) -> dict[str, Column]:
    """Terms of local shape: L1 of offsets and thickness in shares of the limit, and of the incoherence's sigmoid."""
    mask = (valid == 1).cast("double")
    apart = sum((F.abs(p - t) for p, t in offset), F.lit(0.0)) / len(offset)
    return {"off_l1": masked_mean(apart / limit, mask), "thick_l1": l1(*thickness, mask, limit),
        "ncov_l1": masked_mean(F.abs(1 / (1 + F.exp(-logit)) - incoherence), mask)}


def far_term(prediction: Column, target: Column, mask: Column, margin: float) -> Column:
    """How far predictions come below half the margin where the target is at least the margin from zero."""
    return masked_mean(F.greatest(F.lit(0.0), margin / 2 - F.abs(prediction)), mask * (F.abs(target) >= margin).cast("double"))


def shell_term(prediction: Column, target: Column, shell: Column, mask: Column, margin: float) -> Column:
    """How far predictions come below the margin in the shell around the target's zero set, where the target itself doesn't."""
    return masked_mean(F.greatest(F.lit(0.0), margin - F.abs(prediction)), mask * shell * (F.abs(target) >= margin).cast("double"))
