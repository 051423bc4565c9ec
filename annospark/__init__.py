"""annospark — Spark-native multi-label annotation analytics over an ontology.

Every operator is a function ``DataFrame -> DataFrame`` that takes column
names as arguments, keeps scores sparse and long (an absent pair is 0.0),
and leaves physical planning to Catalyst / AQE.
"""

__version__ = "0.1.0"
