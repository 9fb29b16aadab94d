"""Binding of table columns to the roles the metrics need."""

from .binding import Base, SegmentTable, bind
from .roles import Dates, Entity, Sale

__all__ = ["Base", "Dates", "Entity", "Sale", "SegmentTable", "bind"]
