"""corpus_select: choose training text at scale with Spark DataFrames.

Scores every raw document by how much more likely it is under a small target
corpus than under the raw distribution (hashed n-gram statistics, Gaussian
mixtures over embeddings, a relevance classifier, or a blend), then keeps the
best or a weighted sample. Packages: ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame steps), ``sources`` (readers/writers),
``plans`` (end-to-end flows and the query catalog), ``streaming``.
"""

__version__ = "0.1.0"
