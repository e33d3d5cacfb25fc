"""rowharvest: structured-record extraction from tables or streams of web pages, on Spark."""

from rowharvest.fields import Field
from rowharvest.session import configure

__all__ = ["Field", "configure"]
