"""The bundled table of tools: what their own documentation says that they are configured by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tools import RULE_SCHEMA

#: Tool, files, folders, language, category.
RULES = [
    ("Ansible", ["ansible.cfg"], [], None, "deployment"),
    ("Babel", ["babel.config.js", "babel.config.json", ".babelrc"], [], "JavaScript", "build"),
    ("Bazel", ["WORKSPACE", "MODULE.bazel", "BUILD.bazel", ".bazelrc"], [], None, "build"),
    ("Black", ["black.toml"], [], "Python", "formatter"),
    ("Buildkite", ["pipeline.yml"], [".buildkite"], None, "ci"),
    ("Bundler", ["Gemfile", "Gemfile.lock"], [], "Ruby", "packages"),
    ("Cargo", ["Cargo.toml", "Cargo.lock"], [], "Rust", "packages"),
    ("CircleCI", [], ["/.circleci"], None, "ci"),
    ("Clang-Format", [".clang-format"], [], "C++", "formatter"),
    ("CMake", ["CMakeLists.txt", "*.cmake"], [], "C++", "build"),
    ("Composer", ["composer.json", "composer.lock"], [], "PHP", "packages"),
    ("Conda", ["environment.yml", "meta.yaml"], [], "Python", "packages"),
    ("Cypress", ["cypress.config.js", "cypress.config.ts", "cypress.json"], ["cypress"], "JavaScript", "test"),
    ("Dependabot", ["dependabot.yml"], [], None, "dependencies"),
    ("Docker", ["Dockerfile", "*.dockerfile", ".dockerignore"], [], None, "containers"),
    ("Docker Compose", ["docker-compose.yml", "docker-compose.yaml", "compose.yaml", "compose.yml"], [], None, "containers"),
    ("EditorConfig", [".editorconfig"], [], None, "editor"),
    ("ESLint", [".eslintrc", ".eslintrc.js", ".eslintrc.json", ".eslintrc.yml", "eslint.config.js", "eslint.config.mjs"], [], "JavaScript", "linter"),
    ("Flake8", [".flake8"], [], "Python", "linter"),
    ("Git", ["/.gitignore", ".gitattributes"], [], None, "version control"),
    ("GitHub Actions", [], ["/.github/workflows"], None, "ci"),
    ("GitLab CI", ["/.gitlab-ci.yml"], [], None, "ci"),
    ("Go Modules", ["go.mod", "go.sum"], [], "Go", "packages"),
    ("golangci-lint", [".golangci.yml", ".golangci.yaml", ".golangci.toml"], [], "Go", "linter"),
    ("Gradle", ["build.gradle", "build.gradle.kts", "settings.gradle", "gradlew"], [], "Java", "build"),
    ("Helm", ["Chart.yaml"], [], None, "deployment"),
    ("Jenkins", ["Jenkinsfile"], [], None, "ci"),
    ("Jest", ["jest.config.js", "jest.config.ts", "jest.config.json"], [], "JavaScript", "test"),
    ("Jupyter", ["*.ipynb"], [], "Python", "notebooks"),
    ("Kustomize", ["kustomization.yaml", "kustomization.yml"], [], None, "deployment"),
    ("Lerna", ["lerna.json"], [], "JavaScript", "monorepo"),
    ("Make", ["Makefile", "GNUmakefile", "*.mk"], [], None, "build"),
    ("Maven", ["pom.xml", "mvnw"], [], "Java", "build"),
    ("Meson", ["meson.build"], [], "C++", "build"),
    ("MkDocs", ["mkdocs.yml"], [], None, "documentation"),
    ("Mypy", ["mypy.ini", ".mypy.ini"], [], "Python", "types"),
    ("Next.js", ["next.config.js", "next.config.mjs", "next.config.ts"], [], "JavaScript", "framework"),
    ("Nix", ["flake.nix", "shell.nix", "default.nix"], [], None, "build"),
    ("npm", ["package.json", "package-lock.json", ".npmrc"], [], "JavaScript", "packages"),
    ("NuGet", ["nuget.config", "packages.config", "*.csproj"], [], "C#", "packages"),
    ("Nx", ["nx.json"], [], "JavaScript", "monorepo"),
    ("PHPUnit", ["phpunit.xml", "phpunit.xml.dist"], [], "PHP", "test"),
    ("pip", ["requirements.txt", "requirements-dev.txt"], [], "Python", "packages"),
    ("Playwright", ["playwright.config.ts", "playwright.config.js"], [], "JavaScript", "test"),
    ("pnpm", ["pnpm-lock.yaml", "pnpm-workspace.yaml"], [], "JavaScript", "packages"),
    ("Poetry", ["poetry.lock"], [], "Python", "packages"),
    ("pre-commit", [".pre-commit-config.yaml"], [], None, "linter"),
    ("Prettier", [".prettierrc", ".prettierrc.json", ".prettierrc.js", "prettier.config.js", ".prettierignore"], [], "JavaScript", "formatter"),
    ("Protocol Buffers", ["*.proto", "buf.yaml"], [], None, "schema"),
    ("Pulumi", ["Pulumi.yaml"], [], None, "deployment"),
    ("pytest", ["pytest.ini", "conftest.py"], [], "Python", "test"),
    ("Python Project", ["pyproject.toml", "setup.py", "setup.cfg"], [], "Python", "packages"),
    ("Renovate", ["renovate.json", ".renovaterc"], [], None, "dependencies"),
    ("Rollup", ["rollup.config.js", "rollup.config.mjs"], [], "JavaScript", "build"),
    ("RuboCop", [".rubocop.yml"], [], "Ruby", "linter"),
    ("Ruff", ["ruff.toml", ".ruff.toml"], [], "Python", "linter"),
    ("Rustfmt", ["rustfmt.toml", ".rustfmt.toml"], [], "Rust", "formatter"),
    ("sbt", ["build.sbt"], [], "Scala", "build"),
    ("Serverless Framework", ["serverless.yml", "serverless.yaml"], [], None, "deployment"),
    ("ShellCheck", [".shellcheckrc"], [], "Shell", "linter"),
    ("Sphinx", ["conf.py"], [], "Python", "documentation"),
    ("Storybook", [], [".storybook"], "JavaScript", "documentation"),
    ("Swift Package Manager", ["Package.swift"], [], "Swift", "packages"),
    ("Tailwind CSS", ["tailwind.config.js", "tailwind.config.ts"], [], "CSS", "framework"),
    ("Terraform", ["*.tf", ".terraform.lock.hcl"], [], None, "deployment"),
    ("tox", ["tox.ini"], [], "Python", "test"),
    ("Travis CI", ["/.travis.yml"], [], None, "ci"),
    ("TypeScript", ["tsconfig.json"], [], "TypeScript", "types"),
    ("uv", ["uv.lock"], [], "Python", "packages"),
    ("Vagrant", ["Vagrantfile"], [], None, "virtual machines"),
    ("Vite", ["vite.config.js", "vite.config.ts"], [], "JavaScript", "build"),
    ("Vitest", ["vitest.config.js", "vitest.config.ts"], [], "JavaScript", "test"),
    ("VS Code", [], ["/.vscode"], None, "editor"),
    ("Webpack", ["webpack.config.js", "webpack.config.ts"], [], "JavaScript", "build"),
    ("Yarn", ["yarn.lock", ".yarnrc", ".yarnrc.yml"], [], "JavaScript", "packages"),
]


def bundled_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], f"rule_pos long, {RULE_SCHEMA}")
