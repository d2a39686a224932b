"""Weights, ranks and word lists: fixed values."""

# Fixed values.
MATCHER_MULTIPLIERS = {
    'global': 1.25,
    'regex': 1.15,
    'string': 1.0,
    'sourcemap': 0.95,
    'filename': 0.85,
}

# Fixed values.
EVIDENCE_WEIGHTS = {
    'package_reference': 100.0,
    'package_marker': 95.0,
    'manifest': 95.0,
    'runtime_pattern': 90.0,
    'metadata': 85.0,
    'html_element': 80.0,
    'script_reference': 80.0,
    'banner': 80.0,
    'bundle_runtime': 70.0,
    'bundle_marker': 70.0,
    'source_map_metadata': 65.0,
    'import_export': 60.0,
    'ast_extraction': 55.0,
    'string_literal': 40.0,
    'filename': 50.0,
    'http_header': 80.0,
    'http_metadata': 75.0,
    'source_map': 60.0,
    'script_content': 30.0,
    'version_candidate': 25.0,
    'custom': 20.0,
}

# Fixed values.
VERSION_SOURCE_PRIORITIES = {
    'package': 100.0,
    'package_metadata': 100.0,
    'runtime': 95.0,
    'version_candidate': 90.0,
    'manifest': 90.0,
    'build_metadata': 85.0,
    'metadata': 85.0,
    'sourcemap': 80.0,
    'source_map': 80.0,
    'banner': 75.0,
    'comment': 65.0,
    'content': 55.0,
    'bundle': 55.0,
    'inline': 50.0,
    'global': 50.0,
    'minified': 45.0,
    'filename': 40.0,
    'regex': 20.0,
    'unknown': 15.0,
}

# Fixed values.
EXTENSION_CATEGORIES = {
    '.js': 'javascript',
    '.mjs': 'javascript',
    '.cjs': 'javascript',
    '.css': 'css',
    '.json': 'json',
    '.map': 'map',
    '.webmanifest': 'manifest',
    '.wasm': 'wasm',
    '.woff': 'font',
    '.woff2': 'font',
    '.ttf': 'font',
    '.otf': 'font',
    '.eot': 'font',
    '.xml': 'xml',
    '.txt': 'text',
    '.png': 'image',
    '.jpg': 'image',
    '.jpeg': 'image',
    '.gif': 'image',
    '.webp': 'image',
    '.svg': 'image',
    '.ico': 'image',
    '.avif': 'image',
}

# Fixed values.
TYPE_CLASSES = {
    'aws-access-key': 'SECRETS',
    'google-api-key': 'SECRETS',
    'firebase-key': 'SECRETS',
    'stripe-secret-key': 'SECRETS',
    'github-token': 'SECRETS',
    'gitlab-token': 'SECRETS',
    'slack-token': 'SECRETS',
    'discord-token': 'SECRETS',
    'twilio-key': 'SECRETS',
    'sendgrid-key': 'SECRETS',
    'azure-key': 'SECRETS',
    'webhook-token': 'SECRETS',
    'high-entropy-token': 'SECRETS',
    'private-key-header': 'SECRETS',
    'jwt-token': 'AUTHENTICATION',
    'bearer-token-ref': 'AUTHENTICATION',
    'basic-auth-token': 'AUTHENTICATION',
    'public-ssh-key': 'SECRETS',
    'pem-block': 'SECRETS',
    'certificate-block': 'SECRETS',
    'config-file-ref': 'CONFIGURATION',
    'env-reference': 'CONFIGURATION',
    'runtime-config': 'CONFIGURATION',
    'frontend-config': 'CONFIGURATION',
    'public-config': 'CONFIGURATION',
    'app-config': 'CONFIGURATION',
    'framework-config': 'CONFIGURATION',
    'deployment-config': 'CONFIGURATION',
    'client-config': 'CONFIGURATION',
    'dotenv-reference': 'CONFIGURATION',
    'webpack-build': 'BUILD',
    'vite-build': 'BUILD',
    'rollup-build': 'BUILD',
    'parcel-build': 'BUILD',
    'nextjs-build': 'BUILD',
    'nuxt-build': 'BUILD',
    'angular-build': 'BUILD',
    'react-build': 'BUILD',
    'vue-build': 'BUILD',
    'svelte-build': 'BUILD',
    'remix-build': 'BUILD',
    'astro-build': 'BUILD',
    'build-id': 'BUILD',
    'chunk-naming': 'BUILD',
    'bundle-metadata': 'BUILD',
    'version-metadata': 'BUILD',
    'asset-manifest': 'BUILD',
    'debug-comment': 'DEBUG',
    'dev-banner': 'DEBUG',
    'debug-endpoint': 'DEBUG',
    'stack-trace': 'DEBUG',
    'framework-debug': 'DEBUG',
    'dev-mode': 'DEBUG',
    'build-env': 'DEBUG',
    'backup-filename': 'BACKUP',
    'temp-file': 'BACKUP',
    'archive-ref': 'BACKUP',
    'old-config-ref': 'BACKUP',
    'legacy-asset': 'BACKUP',
    'deployment-leftover': 'BACKUP',
    'dev-server': 'DEVELOPMENT',
    'hot-reload': 'DEVELOPMENT',
    'source-artifact': 'METADATA',
    'infra-metadata': 'INFRASTRUCTURE',
}

# Fixed values.
CATEGORY_CLASSES = {
    'secret': 'SECRETS',
    'configuration': 'CONFIGURATION',
    'build': 'BUILD',
    'debug': 'DEBUG',
    'backup': 'BACKUP',
    'environment': 'CONFIGURATION',
    'source': 'METADATA',
    'client-config': 'CONFIGURATION',
    'development': 'DEVELOPMENT',
    'infrastructure': 'INFRASTRUCTURE',
    'api': 'API',
    'identity': 'IDENTITY',
    'cloud': 'CLOUD',
    'third-party': 'THIRD_PARTY',
    'analytics': 'ANALYTICS',
    'monitoring': 'MONITORING',
    'technology': 'FRAMEWORK',
    'token': 'AUTHENTICATION',
}

# Fixed values.
WEAK_PATTERNS = (
    'filename/bundle',
    'filename/chunk',
    'global/angular',
    'global/bootstrap',
    'global/l',
    'global/ng',
    'global/vue',
    'string/$scope',
    'string/bootstrap',
    'string/l.map(',
)

# Fixed values.
STRONG_PATTERNS = (
    'global/__next_data__',
    'global/__nuxt__',
    'global/react',
    'global/webpackbootstrap',
    'regex/@tailwind ',
    r"regex/angular\.module",
    r"regex/angular\.module\(",
    'regex/react\\.version\\s*=\\s*["\\\'][\\d.]',
    r'regex/reconcilerversion\s*:\s*"[\d.]',
    'regex/vue\\.version\\s*=\\s*["\\\'][\\d.]',
    r"regex/window\.next\s*=\s*\{",
    'regex/ɵɵdefinecomponent',
    'string//@vite/client',
    'string/@angular/core',
    'string/@angular/platform-browser',
    'string/@mui/icons-material',
    'string/@mui/material',
    'string/__next_data__',
    'string/__nuxt__',
    'string/__tailwindcss_version__',
    'string/__turbopack_load__',
    'string/__vite__',
    'string/__vue__',
    'string/__webpack_modules__',
    'string/__webpack_require__',
    'string/bootstrap.bundle.min',
    'string/bootstrap.min.css',
    'string/data-bs-theme',
    'string/data-bs-toggle',
    'string/definecomponent',
    'string/import.meta.hot',
    'string/l.icon.default',
    'string/l.tilelayer(',
    'string/muithemeprovider',
    'string/next/dist',
    'string/nextversion',
    'string/react.createelement',
    'string/react.production.min',
    'string/react/jsx-runtime',
    'string/reactdom',
    'string/reactdom.createroot',
    'string/self.__next_data__',
    'string/sveltecomponent',
    'string/tailwind.config',
    'string/turbopack',
    'string/turbopack-runtime',
    'string/vue.createapp',
    'string/webpackchunk',
    'string/wp-content/themes',
    'string/wp-includes/js',
    'string/wp-json/wp/v2',
)

# Fixed values.
SECRET_TYPES = (
    'aws-access-key',
    'azure-key',
    'discord-token',
    'firebase-key',
    'github-token',
    'gitlab-token',
    'google-api-key',
    'high-entropy-token',
    'private-key-header',
    'sendgrid-key',
    'slack-token',
    'stripe-secret-key',
    'twilio-key',
    'webhook-token',
)

# Fixed values.
HIGH_RISK_TYPES = (
    'backup-filename',
    'basic-auth-token',
    'bearer-token-ref',
    'certificate-block',
    'debug-endpoint',
    'deployment-leftover',
    'jwt-token',
    'pem-block',
    'public-ssh-key',
    'stack-trace',
)

# Fixed values.
COMMON_RESPONSE_HEADERS = (
    'server',
    'date',
    'content-type',
    'content-length',
    'transfer-encoding',
    'cache-control',
    'etag',
    'expires',
    'pragma',
    'vary',
    'connection',
    'location',
    'x-powered-by',
    'via',
    'age',
    'accept-ranges',
    'allow',
    'link',
    'content-encoding',
)

# Fixed values.
SECURITY_HEADERS = (
    'content-security-policy',
    'strict-transport-security',
    'x-frame-options',
    'x-content-type-options',
    'referrer-policy',
    'permissions-policy',
    'cross-origin-opener-policy',
    'cross-origin-embedder-policy',
    'cross-origin-resource-policy',
    'expect-ct',
    'nel',
    'report-to',
    'clear-site-data',
    'origin-agent-cluster',
)

# Fixed values.
CORS_HEADERS = (
    'access-control-allow-origin',
    'access-control-allow-methods',
    'access-control-allow-headers',
    'access-control-allow-credentials',
    'access-control-expose-headers',
    'access-control-max-age',
)

# Fixed values.
CACHE_HEADERS = (
    'cache-control',
    'expires',
    'etag',
    'pragma',
    'age',
    'vary',
)

# Fixed values.
PLACEHOLDERS = (
    '123456',
    '12345678',
    '123456789',
    'admin',
    'api_key',
    'api_key_here',
    'apikey',
    'change_me',
    'change_me_now',
    'changeit',
    'changeme',
    'default',
    'dummy',
    'enter_password',
    'example',
    'fake',
    'fixme',
    'guest',
    'insert_password',
    'invalid_password',
    'login',
    'none',
    'null',
    'passw0rd',
    'passwd',
    'password',
    'password123',
    'password_here',
    'placeholder',
    'pwd',
    'qwerty',
    'redacted',
    'replace_me',
    'replace_me_now',
    'root',
    'sample',
    'secret',
    'secret123',
    'secret_here',
    'test',
    'testing',
    'todo',
    'token',
    'token_here',
    'undefined',
    'user',
    'username',
    'xxx',
    'xxxx',
    'xxxxx',
    'your_api_key',
    'your_api_key_here',
    'your_password',
    'your_password_here',
    'your_secret',
    'your_secret_here',
    'your_token',
    'your_token_here',
)

# Fixed values.
PLACEHOLDER_PREFIXES = (
    'your_',
    'example_',
    'sample_',
    'dummy_',
    'fake_',
    'replace_',
    'insert_',
    'enter_',
    'change_',
    'put_',
    'set_',
)

# Fixed values.
PLACEHOLDER_SUFFIXES = (
    '_here',
    '_placeholder',
    '_example',
    '_sample',
    '_todo',
)

# Fixed values.
PROVIDER_PREFIXES = (
    'akia',
    'asia',
    'ghp_',
    'gho_',
    'ghu_',
    'ghs_',
    'ghr_',
    'github_pat_',
    'sk_live_',
    'sk_test_',
    'rk_live_',
    'rk_test_',
    'xoxb-',
    'xoxp-',
    'xoxa-',
    'xoxr-',
    'aiza',
    'sk-ant-',
    'sk-',
    'glpat-',
    'sg.',
)

# Fixed values.
WEAK_VALUES = (
    'abc123',
    'abc12345',
    'admin123',
    'iloveyou',
    'letmein',
    'password1',
    'password12',
    'password123',
    'password1234',
    'welcome1',
)

# Fixed values.
STRUCTURED_RULES = (
    'anthropic-key',
    'aws-access-key',
    'aws-secret-key',
    'azure-key',
    'basic-auth-token',
    'certificate',
    'discord-token',
    'firebase-api-key',
    'gcp-service-account',
    'github-token',
    'gitlab-token',
    'google-api-key',
    'jwt-token',
    'ldap-credentials',
    'mongodb-uri',
    'mysql-uri',
    'openai-key',
    'postgresql-uri',
    'private-key',
    'redis-uri',
    'slack-token',
    'smtp-credentials',
    'ssh-private-key',
    'stripe-secret-key',
    'twilio-key',
)

# Fixed values.
MANIFEST_FILES = (
    'browserconfig.xml',
    'manifest.json',
    'site.webmanifest',
)

# Fixed values.
WORKER_SUFFIXES = (
    '.worker.js',
    '.worker.mjs',
    '.sharedworker.js',
)
