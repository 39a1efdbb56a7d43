"""Tabular feature, scoring and evaluation jobs for binary targets on Spark."""

from tabscore.functions.columns import (
    bit_columns,
    blend_mean,
    blend_weighted,
    coalesce_cols,
    flip,
    format_metric,
    product,
    split_code,
    square,
    to_binary,
    when_agree,
    z,
)
from tabscore.models.boost import boost, boost_importance, boost_stages, boost_trees
from tabscore.models.experts import balanced_assign, balanced_experts
from tabscore.models.gbt import (
    best_rounds,
    deviance_by_round,
    first_fraction,
    gbt,
    importance,
    metric_history,
    permutation_importance,
    staged_auc,
    staged_scores,
    watchlist,
)
from tabscore.models.grid import gbt_grid, grid_search, net_grid, refit
from tabscore.models.kernel import kernel_svm, kernel_svm_fit
from tabscore.models.mlp import mlp, mlp_early_stop
from tabscore.models.net import NetSettings, NetTrainer, net, net_importance, net_model, train_net
from tabscore.models.pruning import prune_tree, pruning_sequence
from tabscore.models.rotation import rotation_forest
from tabscore.models.score import score, score_many
from tabscore.models.store import load_model, save_model
from tabscore.models.svm import clustered_svm, gated_experts, kernel_svm_approx
from tabscore.operators.joins import (
    bind_by_key,
    bind_by_order,
    join_anchor,
    join_blocks,
    join_features,
    join_predictions,
    lookup_stats,
)
from tabscore.operators.metrics import (
    accuracy,
    auc,
    best_thresholds,
    early_stop,
    gains_lift,
    performance,
    stop_round,
    threshold_sweep,
)
from tabscore.operators.ordered import add_row_id, prefix_sums
from tabscore.operators.profile import (
    contingency,
    corr_matrix,
    corr_max,
    corr_mean,
    count_by,
    histogram,
    histogram_bins,
    histogram_by,
    max_of,
    population_stats,
    quantile_profile,
    six_numbers,
    variable_stats,
)
from tabscore.operators.reshape import to_long, to_wide, union_fill, union_same
from tabscore.operators.scaling import Scaler, ScalerModel, SplitScaler, SplitScalerModel, zscore, zscore_product
from tabscore.operators.selection import (
    assemble,
    cols_containing,
    cols_except,
    cols_starting,
    first_rows,
    index_label,
    leaderboard,
    order_and_suffix,
    split_by_flag,
    to_double,
)
from tabscore.plans.blend import blend, equal
from tabscore.plans.features import (
    BitEncoder,
    BitEncoderModel,
    feature_set,
    feature_table,
    scaled_features,
    scaled_tournament,
)
from tabscore.plans.tournament import public_private_auc, rank_latest, validate_submission
from tabscore.session import tune
from tabscore.sources.contest import contest, order_features, tournament, training
from tabscore.sources.scratch import materialize, release, release_scratch
from tabscore.sources.tables import read_submission, read_table, write_features, write_submission
from tabscore.streaming.live import score_stream

__all__ = [name for name in dir() if not name.startswith("_")]
