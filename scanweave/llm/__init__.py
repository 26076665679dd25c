"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it; ``scanweave.llm.queries`` lists
the registered queries and ``corpus_pipeline`` at the repository top chains
five of the operators.
"""
