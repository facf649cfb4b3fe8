"""Seasonal time series of pixels on PySpark: sources, operators, runs, search and tools."""

from verdure.config import Phenology, Reflectance, Settings
from verdure.plans.runner import Runner
from verdure.sql import register

__all__ = ["Phenology", "Reflectance", "Runner", "Settings", "register"]
