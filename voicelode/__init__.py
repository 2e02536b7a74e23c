"""voicelode: complaint and demand mining over community posts, on PySpark."""

from voicelode.settings import Settings

__all__ = ["Settings"]
