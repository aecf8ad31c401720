"""Training-data operators on Spark: one module per operator, ``queries.py``
registers the ``opN_*`` queries.  Nothing else in the library imports this
package."""
