"""DataFrame operators over the relations of ``cairn.schemas``."""
