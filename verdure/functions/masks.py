"""Cloud and quality masks and the vegetation index, as column expressions.  Invalid values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdure.config import Reflectance


def index(red: Column, nir: Column) -> Column:
    """(nir - red) / (nir + red) of positive reflectances, within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (nir - red) / (nir + red)))


def _reflectance(dn: Column, offset: Column | float, c: Reflectance) -> Column:
    return F.greatest((dn - offset) / c.scale, F.lit(1e-4))


def ndvi_from_classes(red: Column, nir: Column, cls: Column, when: Column, c: Reflectance) -> Column:
    """Scenes with a class band: positive numbers in a clear class; the offset applies from its date on."""
    offset = F.when(when >= F.lit(c.offset_from).cast("timestamp_ntz"), c.offset).otherwise(0.0)
    return F.when((red > 0) & (nir > 0) & cls.isin(*c.clear_classes), index(_reflectance(red, offset, c), _reflectance(nir, offset, c)))


def clear_bits(qa: Column, c: Reflectance) -> Column:
    """No bad bit set and aerosol not at its highest level."""
    return (qa.bitwiseAND(F.lit(c.bad_bits)) == 0) & (F.shiftright(qa, c.aerosol_shift).bitwiseAND(F.lit(3)) != c.aerosol_high) & (qa != c.qa_fill)


def ndvi_from_bits(red: Column, nir: Column, qa: Column, c: Reflectance) -> Column:
    """Scenes with a bit field: neither band at its fill value and clear bits."""
    return F.when((red != c.fill) & (nir != c.fill) & clear_bits(qa, c), index(_reflectance(red, 0.0, c), _reflectance(nir, 0.0, c)))
