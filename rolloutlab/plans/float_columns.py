"""Double-typed output columns of each registered query.

Both the Spark result and the SQL oracle round these to 6 decimal places, so
last-bit differences between engines (summation order, libm vs Java math)
cannot change a value hash. Derived from the Spark output schemas;
``tests/test_registry.py`` checks it stays in sync.
"""

FLOAT_COLUMNS: dict[str, list[str]] = {
    'next_turn_prompt': ['last_mse'],
    'reduce_rows_prod': ['l_quantity_sum', 'l_quantity_prod'],
    'score_with_limits': ['reward'],
    'adaptive_avg_pool': ['avg_pool'],
    'addmm': ['v'],
    'batch_norm': ['total', 'total_sq'],
    'bmm': ['v'],
    'close_checks': ['mse'],
    'compare_variants': ['eager_us', 'compiled_us', 'candidate_us', 'speedup_eager', 'speedup_compile'],
    'completion_lengths': ['mean_length', 'p50', 'p90', 'p99', 'clipped_share'],
    'conv1x1': ['v'],
    'device_time': ['device_us'],
    'fill_missing': ['reward'],
    'finalise_noise': ['reward'],
    'format_feedback': ['speedup_eager', 'speedup_compile', 'reward'],
    'group_advantage': ['reward', 'advantage'],
    'group_norm': ['total', 'total_sq'],
    'layer_norm': ['total', 'total_sq'],
    'linear': ['v'],
    'log_softmax': ['total', 'total_sq'],
    'map_leaves': ['arr_sum', 'first_leaf', 'last_leaf', 'label_leaf'],
    'matmul': ['v'],
    'max_pool': ['max_pool'],
    'mse_table': ['mse'],
    'pair_outputs': ['leaf_sum'],
    'parse_profile_log': ['eager_us', 'compiled_us', 'candidate_us'],
    'parse_verify_log': ['avg_mse'],
    'partial_reward': ['reward'],
    'rate_by_step_window': ['error_rate', 'compliance'],
    'reduce_rows': ['value_sum', 'value_mean', 'value_max', 'value_min'],
    'reduce_vectors': ['sum_of_sums', 'mean_of_means', 'max_elem', 'min_elem', 'sum_of_prods'],
    'rms_norm': ['total', 'total_sq'],
    'roll_up_checks': ['avg_mse'],
    'safe_apply': ['score'],
    'score_rollouts': ['reward'],
    'softmax': ['total', 'total_sq'],
    'softmax_rows': ['softmax', 'log_softmax'],
    'speed_reward': ['reward'],
    'spikes': ['value', 'trailing_mean'],
    'stage_and_reward': ['reward_sum'],
    'stage_distribution': ['mean_reward', 'share'],
    'stream_scores': ['mean_reward'],
    'stream_timeout_join': ['reward'],
    'stream_trajectory': ['reward'],
    'trajectory': ['reward'],
    'vec_abs': ['total', 'total_sq'],
    'vec_add': ['total', 'total_sq'],
    'vec_affine': ['total', 'total_sq'],
    'vec_axpy': ['total', 'total_sq'],
    'vec_clamp': ['total', 'total_sq'],
    'vec_elu': ['total', 'total_sq'],
    'vec_exp': ['total', 'total_sq'],
    'vec_gelu': ['total', 'total_sq'],
    'vec_hardsigmoid': ['total', 'total_sq'],
    'vec_hardswish': ['total', 'total_sq'],
    'vec_leaky_relu': ['total', 'total_sq'],
    'vec_log': ['total', 'total_sq'],
    'vec_mish': ['total', 'total_sq'],
    'vec_multiply': ['total', 'total_sq'],
    'vec_neg': ['total', 'total_sq'],
    'vec_pow': ['total', 'total_sq'],
    'vec_reciprocal': ['total', 'total_sq'],
    'vec_relu': ['total', 'total_sq'],
    'vec_sigmoid': ['total', 'total_sq'],
    'vec_sign': ['total', 'total_sq'],
    'vec_silu': ['total', 'total_sq'],
    'vec_square': ['total', 'total_sq'],
    'vec_subtract': ['total', 'total_sq'],
    'vec_tanh': ['total', 'total_sq'],
    'vec_where': ['total', 'total_sq'],
    'with_reward': ['reward'],
}
