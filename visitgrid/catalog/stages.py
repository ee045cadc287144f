"""Stage tables shared by the steps of one query run."""

from functools import cached_property

from pyspark.sql import functions as F

from visitgrid.catalog.cleansing import cleaned
from visitgrid.operators import cleanse as K
from visitgrid.operators import joins as J
from visitgrid.plans import roles as R
from visitgrid.plans.ordered import materialize


class Stages:
    """Stage tables of one query run: a stage that several later steps read is written once."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        self._tables = {}

    def once(self, name, build):
        """The named stage, built and written at its first use."""
        if name not in self._tables:
            self._tables[name] = materialize(build())
        return self._tables[name]

    @cached_property
    def visits(self):
        """The raw visits, for queries that read them beside the cleaned ones."""
        return materialize(R.visits(self.spark, self.sf))

    @cached_property
    def cleaned(self):
        # only the columns later steps read: nothing prunes a written table afterwards
        cols = ("visit_id", "jk", "umr_start", "umr_av", "umr_status", "umr_art", "cost")
        return materialize(cleaned(self.spark, self.sf, self.__dict__.get("visits")).select(*cols))

    @cached_property
    def entities(self):
        return K.coalesce_join_key(R.entities(self.spark, self.sf), name="jk")

    @cached_property
    def joined(self):
        return K.clean_categoricals(J.inner_join_coalesce(self.cleaned, self.entities, "jk"), ["derivat"])

    @cached_property
    def labelled(self):
        v = self.cleaned.where(F.col("umr_start") >= F.lit(R.LABEL_FROM).cast("timestamp"))
        return J.label_semi_join(self.entities, v, "jk")
