"""Spark-native dynamics of per-entity time series and interpretable classification.

Names are imported when first used, so a Python worker that runs one function doesn't load all of the library.
"""

from importlib import import_module

_EXPORTS = {
    "functions.columns": "min_max_scaled",
    "functions.labels": "extract_au_code humanise_au_label humanise_au_labels",
    "operators.classifiers": "CLASSIFIER_NAMES fit_classifiers make_classifier make_classifiers",
    "operators.cleaning": "FeatureCleaner feature_diagnostics",
    "operators.evaluation": "classification_metrics confusion_matrix_frame cross_validate_grouped delong_roc_test evaluate_models roc_auc_delong_ci",
    "operators.features": "FEATURE_GROUPS FEATURE_NAMES TimeSeriesFeatureExtractor apply_rowwise extract_timeseries_features frame_features",
    "functions.series": "extract_features",
    "operators.nmf": "NMFDecomposer nmf_cophenetic_correlation nmf_rank_cv_sweep nmf_rank_mse_sweep nmf_reconstruction_error nmf_reconstruction_r2_per_au",
    "operators.normalisation": "ZScoreShiftNormalizer",
    "operators.plots": "plot_accuracy_comparison plot_boruta_importance plot_boruta_stability plot_confusion_matrix plot_decision_boundary plot_feature_clusters plot_feature_diagnostics plot_nmf_face_maps plot_probability_distributions plot_roc_curves plot_threshold_sweep",
    "operators.representatives": "RepresentativeAUSelector select_representative_aus",
    "operators.reshape": "pivot_features_wide reshape_to_wide split_wide",
    "operators.selection": "BorutaRun BorutaSelector boruta_feature_stats correlated_feature_clusters gini_importance oob_permutation_importance tentative_rough_fix",
    "operators.smoothing": "RollingSmoother",
    "operators.splitting": "RepeatedStratifiedGroupKFold group_train_test_split pair_group_report pair_groups pair_groups_from_filenames paired_train_test_split",
    "operators.tuning": "ThresholdTuningResult threshold_grid threshold_sweep tune_selection_threshold",
    "operators.external": "CallableFeatureExtractor MatrixFeatureExtractor RFeatureExtractor cmfts_r_features",
    "operators.faces": "FaceModel load_face_model",
    "persistence": "load save",
    "plans": "DynamicsPipeline",
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    value = getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
    globals()[name] = value
    return value


def __dir__() -> list[str]:
    return __all__
