"""Pregnancy-episode inference over OMOP event tables, as Spark DataFrame plans."""

from storkline.config import FixedConcepts, Params
from storkline.sources.omop import Lists, Tables

__all__ = ["FixedConcepts", "Lists", "Params", "Tables"]
