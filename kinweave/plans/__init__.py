"""Named queries; importing the modules registers them."""

from . import archive, careers, cells, institutions, people, places, publish, quality, records, streams, texts, ties
from .registry import QUERIES, SQL
