"""Operators for training-data pipelines.

One module per operator; ``queries`` registers them. Nothing outside this
package (and the pipeline module at the repository top) imports it.
"""
