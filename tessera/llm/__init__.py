"""Training-data operators: one module per operator, each built by its named method.

``textops``          numpy helpers over the bytes of Arrow text columns
``storage``          tables in the shared checkpoint folder that cut lineage
``context_mixing``   language-model scoring by logistic context mixing
``url_filter``       URL rules and a logistic regression on character n-grams
``decontam``         size-partitioned MinHash containment search
``quality_mil``      quality scores by gated-attention multiple-instance learning
``bpe``              byte-level BPE by longest-match backtracking
``quality_rules``    rule bitmask ledger and versioned policies
``suffix_dedup``     repeated-passage removal over sparse suffix orders
``jaccard_join``     chosen-path Jaccard join on word n-grams
``chat``             chat formatting with Spark expressions
``toxicity``         convolutional toxicity classifier
``periodic_runs``    runs of periodic words by maximal pairs of the LCP-interval tree
``language_gru``     language identification by a bidirectional GRU over bytes
``whitening``        embedding whitening from the polarisation covariance
``queries``          the registered queries and their SQL
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this subpackage run inside Python workers; pickle them by value
# so executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
