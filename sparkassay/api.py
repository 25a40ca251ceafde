"""What a user imports."""

from .functions.schema import Comparator, DatasetConstraints, Domain, Feature, Presence, Schema, SparseFeature, ValueCount, WeightedFeature
from .functions.views import FeatureView, SliceView, StatisticsView
from .operators.inference import infer_schema, update_schema
from .operators.rows import anomalous, anomaly_counts, samples
from .operators.rows import custom as custom_validation
from .operators.skew import FeatureSkew, skew_results
from .operators.slicing import FeatureSlicer
from .operators.validation import Anomalies, Options, validate, validate_instance, validate_slices
from .plans.entry import statistics_from_csv, statistics_from_pandas, statistics_from_rows
from .plans.generators import BatchGenerator, Composite, FeatureGenerator, Part, PartitionedGenerator
from .plans.statistics import Statistics, StatsOptions, generate_statistics
from .sources.examples import read_examples
from .sources.readers import from_dicts, from_pandas, read_csv, read_rows, read_vocabulary
from .sources.statistics_io import load as load_statistics
from .sources.statistics_io import write_binary, write_records, write_text

__all__ = [
    "Anomalies", "BatchGenerator", "Comparator", "Composite", "DatasetConstraints", "Domain", "Feature", "FeatureGenerator", "FeatureSkew", "FeatureSlicer", "FeatureView", "Options", "Part", "PartitionedGenerator", "Presence", "Schema", "SliceView", "SparseFeature", "Statistics", "StatisticsView", "StatsOptions", "ValueCount", "WeightedFeature", "anomalous", "anomaly_counts", "custom_validation", "from_dicts", "from_pandas", "generate_statistics", "infer_schema", "load_statistics", "read_csv", "read_examples", "read_rows", "read_vocabulary", "samples", "skew_results", "statistics_from_csv", "statistics_from_pandas", "statistics_from_rows", "update_schema", "validate", "validate_instance", "validate_slices", "write_binary", "write_records", "write_text",
]
